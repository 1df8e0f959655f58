"""Main text of web pages by wrappers that are learned per host.

A wrapper is a union-free regular expression over structural tokens: fixed tags, fixed texts, text
slots, optional and repeated groups. All pages of a host teach it: a text that (nearly) all of them
have at the same kind of place is part of the template; a page's tokens with repeats folded are its
shape, and the unlike shapes of a kind of pages are aligned, first in parts, then the parts with each
other. Pages are of one kind if minimum hashes of their nested tags agree.
Where a page fits its host's wrapper, what stands in slots is the page's own, and
template texts outside a marked article are left out. A page that does not fit (cut or unlike
pages, hosts of few pages) is read by its own tags alone. All walks keep their own stacks, so
pages may nest as deep as they like.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Generator, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborscan.llm.common import stored
from arborscan.llm.urlfilter import host

ENOUGH = 4  # unlike pages that have to share a text before it is template
TENTHS = 9  # of a host's unlike pages have to share it
PARTS = 64  # parts in which a kind's shapes are aligned first
_RECENT, _SHORT = 1000, 2000  # shapes a task remembers, and the longest key streams among them

# fixed values: elements by their role in a page
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav aside footer form button select menu dialog head title noscript iframe object svg canvas".split())
CLOSED_BY_NEXT = frozenset("li dt dd tr td th option".split())
CONTENT = ("article", "main")
#: Words of class, id and role values that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead "
                  "comment comments discussion replies notice cookie cookies consent popup modal subscribe newsletter share social related widget toolbar login search".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_DIGITS = re.compile(r"[0-9]+")
#: A class that begins so tells about something else on the page, as in ``has-sidebar``.
ABOUT = frozenset("has no with without is not".split())
TEXT = "#"
#: Four hash functions; pages whose nested tags are shared in a share s are of one kind with probability s ** 4.
_HASHES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)


def tokens(page: str) -> list[tuple[str, str]]:
    """(key, text) in page order: ``div.ad`` opens, ``/div`` closes, ``#`` is text with references decoded.

    Comments, declarations, scripts and styles are left out, inline tags only part text into pieces,
    text that is white space alone goes. Every element is closed: paragraphs and items by the next
    one, others by the end of what holds them; end tags of nothing are left out.
    """
    out: list[tuple[str, str]] = []
    open_: list[str] = []
    held: Counter[str] = Counter()  # how often each name is open
    pieces: list[str] = []
    at = 0

    def flush() -> None:
        if any(piece.strip() for piece in pieces):
            out.append((TEXT, "".join(pieces)))
        pieces.clear()

    def close(name: str) -> None:
        while True:
            last = open_.pop()
            held[last] -= 1
            out.append((f"/{last}", ""))
            if last == name:
                return

    for match in _TOKEN.finditer(page):
        if match.start() > at:
            pieces.append(html.unescape(page[at: match.start()]))
        at = match.end()
        name = (match[3] or match[6] or "").lower()
        if not name or name in INLINE:
            if name == "br":
                pieces.append(" ")
            continue
        flush()
        if match[2] or match[5]:
            if held[name]:
                close(name)
        elif name not in VOID:
            if open_ and (open_[-1] == "p" or open_[-1] == name and name in CLOSED_BY_NEXT):
                close(open_[-1])
            attributes, marks = match[4] or match[7] or "", ""
            if attributes:
                found = [(k.lower(), _DIGITS.sub("", (v or "").strip("\"'").lower()).split()) for k, v in _ATTRIBUTE.findall(attributes)]
                named = sorted({word for k, words in found for word in (words if k != "hidden" else ["hidden"])})
                marks = "." + " ".join(named) if named else ""
            open_.append(name)
            held[name] += 1
            out.append((name + marks, ""))
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    flush()
    return out + [(f"/{name}", "") for name in reversed(open_)]


def _marked(word: str, name: str) -> bool:
    """Whether a class, id or role says that an element is not the article.

    A content element has to be named so outright (``comment``); others also by the first or last
    part of the word (``cookie-notice``, ``main-nav``), unless it only tells what the page has.
    """
    if word in MARKS:
        return True
    parts = [p for p in re.split(r"[-_:]+", word) if p]
    return name not in CONTENT and len(parts) > 1 and parts[0] not in ABOUT and (parts[0] in MARKS or parts[-1] in MARKS)


@lru_cache(maxsize=4096)
def _element(key: str) -> tuple[str, bool]:
    """Name of an opening key, and whether it opens something that is not the article."""
    name, _, marks = key.partition(".")
    words = marks.split()
    return name, name in BOILERPLATE or name not in ("html", "body") and ("hidden" in words or any(_marked(w, name) for w in words))


def _ends(keys: list[str]) -> list[int]:
    """For every opening key the position of its end tag, for every other its own."""
    out, open_ = list(range(len(keys))), []
    for at, key in enumerate(keys):
        if key.startswith("/"):
            out[open_.pop()] = at
        elif not key.startswith(TEXT):
            open_.append(at)
    return out


def _other(key: str, in_page: bool) -> bool:
    """Whether an opening key starts something that is not the article; the header of a whole page is none of the article's."""
    name, other = _element(key)
    return other or name == "header" and in_page


def content_spans(keys: list[str], ends: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """Name and token ranges of what holds the article.

    These are the outermost ``article`` elements, else ``main``, else ``body``, else (without a
    name) everything. Elements that stand in what is not the article count only if there are no others.
    """
    for wanted in CONTENT:
        for strict in (True, False):
            spans, at = [], 0
            while at < len(keys):
                name, other = _element(keys[at])
                if name == wanted and not other:
                    spans.append((at, ends[at] + 1))
                    at = ends[at]
                elif strict and other:
                    at = ends[at]
                at += 1
            if spans:
                return wanted, spans
    bodies = [at for at, key in enumerate(keys) if key.partition(".")[0] == "body"]
    return ("body", [(bodies[0], ends[bodies[0]] + 1)]) if bodies else ("", [(0, len(keys))])


def main_text(stream: list[tuple[str, str]], template: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of a page's article without the elements that are not part of it: white space as one space, blocks joined by one.

    Texts at the positions of ``template`` are left out too, but not within ``article`` or ``main``:
    there the page itself says that they belong to the article.
    """
    keys = [key for key, _ in stream]
    ends = _ends(keys)
    name, spans = content_spans(keys, ends)
    marked, blocks = name in CONTENT, []
    for at, stop in spans:
        while at < stop:
            key, text = stream[at]
            if key == TEXT:
                if marked or at not in template:
                    blocks.append(" ".join(text.split()))
            elif not key.startswith("/") and _other(key, not marked):
                at = ends[at]
            at += 1
    return " ".join(b for b in blocks if b)


# Key streams teach wrappers. A text's key is "#", or "#" and a digest if it may be template.
# Wrappers are lists of items [kind, body, optional, repeated, sign]: texts ("#", no body), elements
# (their key, the items inside) and groups ("", the items of one pass). Items of one sign may be the
# same place; the sign of an element in which all text is template tells that text too.
# Steps that call each other are generators and yield the call they wait for.


def _run(step: Generator) -> list:
    """The result of a step, with the steps it waits for on a list instead of the call stack."""
    waiting, value = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
    return value


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def text_keys(stream: list[tuple[str, str]]) -> list[str]:
    """The keys of a stream, those of texts with a digest of the text and of the element around it."""
    out, open_ = [], [""]
    for key, text in stream:
        if key == TEXT:
            out.append(TEXT + _digest(open_[-1] + "\n" + " ".join(text.split())))
        else:
            out.append(key)
            if key.startswith("/"):
                open_.pop()
            else:
                open_.append(key)
    return out


@lru_cache(maxsize=65536)
def _nesting(outer: str, key: str) -> int:
    return zlib.crc32(f"{outer}\n{key}".encode("utf-8", "surrogatepass"))


def kind(stream: list[tuple[str, str]]) -> int:
    """A number that pages of like elements share: four minimum hashes of the set of elements with what is around them."""
    nested, open_ = set(), [""]
    for key, _ in stream:
        if key.startswith("/"):
            open_.pop()
        elif key != TEXT:
            nested.add(_nesting(open_[-1], key))
            open_.append(key)
    if not nested:
        return 0
    least = (np.array(list(nested), np.uint64)[:, None] * _HASHES % (1 << 32)).min(0)
    return int.from_bytes(hashlib.blake2b(least.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def _with_slots(keys: list[str], fixed: set[str] | frozenset[str]) -> list[str]:
    return [TEXT if key.startswith(TEXT) and key not in fixed else key for key in keys]


def _signs(keys: list[str]) -> list[str]:
    """Signs by position; those of end tags are their keys."""
    out, open_ = list(keys), []
    for at, key in enumerate(keys):
        if key.startswith(TEXT):
            if open_ and key == TEXT:
                open_[-1][1] = True
            elif open_:
                open_[-1][2].append(key)
        elif key.startswith("/"):
            start, slots, texts = open_.pop()
            inside = _digest("".join(texts)) if any(texts) else ""
            if inside and not slots:
                out[start] = f"{keys[start]} {TEXT}{inside}"
            if open_:
                open_[-1][1] |= slots
                open_[-1][2].append(inside)
        else:
            open_.append([at, False, []])
    return out


def parsed(keys: list[str]) -> list:
    """A key stream as nested items, repeats folded."""
    levels: list[list] = [[]]
    for key, sign in zip(keys, _signs(keys)):
        if key.startswith("/"):
            inside = levels.pop()
            levels[-1][-1][1] = _run(_folded(inside))
        else:
            levels[-1].append([TEXT if key.startswith(TEXT) else key, [], False, False, sign])
            if not key.startswith(TEXT):
                levels.append([])
    return _run(_folded(levels[0]))


def _merged(a: list, b: list, again: bool) -> Generator:
    """One item for two of the same kind: two passes of a repeat, or the same place in two pages."""
    if a[0] == "":
        body = []
        for x, y in zip(a[1], b[1]):
            body.append((yield _merged(x, y, False)))
    else:
        body = yield _aligned(a[1], b[1])
    sign = a[4] if a[4] == b[4] else a[0]
    if a[0] == TEXT and TEXT in (a[4], b[4]):  # a page that has its own text there: still the template's place on the others
        sign = b[4] if a[4] == TEXT else a[4]
    return [a[0], body, a[2] and b[2] if again else a[2] or b[2], again or a[3] or b[3], sign]


def _folded(items: list) -> Generator:
    """Neighbouring repeats of the same signs as one repeated item or group, shortest first, of any width."""
    width, numbers = 1, None
    while 2 * width <= len(items):
        if numbers is None:
            known: dict[str, int] = {}
            numbers = np.array([known.setdefault(item[4], len(known)) for item in items])
        stops = np.append(np.flatnonzero(numbers[width:] != numbers[:-width]), len(items) - width)
        if np.diff(stops, prepend=-1).max() > width:
            places = np.arange(len(items) - width)
            more = (stops[np.searchsorted(stops, places)] - places) // width  # further passes of what starts here
            out, at = [], 0
            while at < len(items):
                passes = int(more[at]) if at < len(more) else 0
                if not passes:
                    out.append(items[at])
                    at += 1
                    continue
                unit = items[at: at + width]
                for k in range(1, passes + 1):
                    for i in range(width):
                        unit[i] = yield _merged(unit[i], items[at + k * width + i], width == 1)
                out += unit if width == 1 else [["", unit, False, True, "(" + " ".join(x[4] for x in unit) + ")"]]
                at += (passes + 1) * width
            items, numbers = out, None
        width += 1
    return items


def _matching(a: list, b: list, names: list[int]) -> Iterator[tuple]:
    """Stretches that a and b share or have alone, by the first of an item's fields ``names`` that is not empty."""
    first, second = ([next(filter(None, (x[n] for n in names))) for x in side] for side in (a, b))
    for kind, a0, a1, b0, b1 in difflib.SequenceMatcher(None, first, second, autojunk=False).get_opcodes():
        yield kind == "equal", a[a0:a1], b[b0:b1]


def _aligned(a: list, b: list) -> Generator:
    """The items of both: equal signs are merged, then equal kinds between them (unequal texts: a slot); the rest becomes optional."""
    out: list = []
    for equal, mine, others in _matching(a, b, [4]):
        for same, left, right in [(True, mine, others)] if equal else _matching(mine, others, [0, 4]):
            if same:
                for x, y in zip(left, right):
                    out.append((yield _merged(x, y, False)))
            else:
                out += [[kind, body, True, repeated, sign] for kind, body, _, repeated, sign in (*left, *right)]
    return (yield _folded(out))


def infer(pages: list[list[str]]) -> list:
    """The wrapper of some pages' key streams, aligned one after another."""
    wrapper: list = []
    for number, keys in enumerate(pages):
        wrapper = parsed(keys) if number == 0 else _run(_aligned(wrapper, parsed(keys)))
    return wrapper


def _flat(items: list) -> list:
    """Items with their depth, in order, without nesting."""
    out, waiting = [], [(0, x) for x in reversed(items)]
    while waiting:
        depth, (kind, body, *rest) = waiting.pop()
        out.append([depth, kind, *rest])
        waiting += [(depth + 1, x) for x in reversed(body)]
    return out


def _nested(rows: list) -> list:
    levels: list[list] = [[]]
    for depth, kind, *rest in rows:
        del levels[depth + 1:]
        item = [kind, [], *rest]
        levels[depth].append(item)
        levels.append(item[1])
    return levels[0]


class Wrapper:
    """A wrapper that tells a page's own texts from those of the template.

    Groups match possessively, level by level: every item takes what it can, in one pass over the
    page. What must be there once may hold another text than usual, which is then the page's own.
    """

    def __init__(self, items: list, fixed: set[str] | frozenset[str] = frozenset()):
        self.items, self.fixed = items, frozenset(fixed)

    def to_json(self) -> str:
        return json.dumps([_flat(self.items), sorted(self.fixed)])

    @classmethod
    def from_json(cls, written: str) -> Wrapper:
        rows, fixed = json.loads(written)
        return cls(_nested(rows), fixed)

    @staticmethod
    def _level(items: list, children: list[int], keys: list[str], signs: list[str]) -> list[tuple[list, int]] | None:
        """(item, position) for every child if the items take them all."""
        pairs: list[tuple[list, int]] = []

        def once(item: list, at: int) -> int:
            if item[0] == "":
                held = len(pairs)
                for inner in item[1]:
                    at = taken(inner, at)
                    if at < 0:
                        del pairs[held:]
                        return -1
                return at
            if at == len(children):
                return -1
            child = children[at]
            kind = TEXT if keys[child].startswith(TEXT) else keys[child]
            if signs[child] != item[4] and (kind != item[0] or (item[2] or item[3]) and kind != TEXT):
                return -1
            pairs.append((item, child))
            return at + 1

        def taken(item: list, at: int) -> int:
            after = once(item, at)
            if after < 0:
                return at if item[2] else -1
            while item[3] and after > at:
                at, after = after, once(item, after)
            return max(at, after)

        at = 0
        for item in items:
            at = taken(item, at)
            if at < 0:
                return None
        return pairs if at == len(children) else None

    def template(self, keys: list[str]) -> set[int] | None:
        """Positions of the template's texts in a page's keys; None if the page does not fit."""
        keys = _with_slots(keys, self.fixed)
        ends, signs, found = _ends(keys), _signs(keys), set()

        def children(at: int, stop: int) -> list[int]:
            out = []
            while at < stop:
                out.append(at)
                at = ends[at] + 1
            return out

        waiting = [(self.items, children(0, len(keys)))]
        while waiting:
            items, inside = waiting.pop()
            pairs = self._level(items, inside, keys, signs)
            if pairs is None:
                return None
            for item, at in pairs:
                if not keys[at].startswith(TEXT):
                    waiting.append((item[1], children(at + 1, ends[at])))
                elif keys[at] == item[4] != TEXT:
                    found.add(at)
        return found

    def span(self, keys: list[str]) -> tuple[int, int] | None:
        """The token range from a fitting page's first text of its own to its last; None if the page does not fit."""
        template = self.template(keys)
        if template is None:
            return None
        own = [at for at, key in enumerate(keys) if key.startswith(TEXT) and at not in template]
        return (own[0], own[-1] + 1) if own else (0, 0)


def shape(keys: list[str], fixed: set[str] | frozenset[str] = frozenset()) -> str:
    """A page's own wrapper as JSON: its keys with texts that are not ``fixed`` as slots, repeats folded."""
    return json.dumps(_flat(parsed(_with_slots(keys, fixed))))


def aligned(shapes: Iterable[str]) -> str:
    """One shape for several, aligned one after another; pages without tokens have no say."""
    wrapper: list = []
    for written in shapes:
        items = _nested(json.loads(written))
        if items:
            wrapper = _run(_aligned(wrapper, items)) if wrapper else items
    return json.dumps(_flat(wrapper))


def learned(pages: list[str]) -> Wrapper:
    """The wrapper of a few pages of a host, as ``learn`` makes it. Pages with the same texts count once; fewer than ``ENOUGH`` unlike ones have no template texts."""
    streams = [text_keys(tokens(page)) for page in pages]
    unlike = {tuple(key for key in keys if key.startswith(TEXT)) for keys in streams} - {()}
    held = Counter(key for texts in unlike for key in set(texts))
    fixed = {key for key, n in held.items() if len(unlike) >= ENOUGH and 10 * n >= TENTHS * len(unlike)}
    shapes = Counter(shape(keys, fixed) for keys in streams)
    items = aligned(sorted(shapes, key=lambda x: (-shapes[x], x)))
    return Wrapper(_nested(json.loads(items)), fixed)


def extracted(page: str | None, wrapper: Wrapper | None) -> tuple[str, bool]:
    """Main text of a page, and whether it fits the wrapper; a page that is all template counts as one that does not."""
    stream = tokens(page or "")
    template = wrapper.template(text_keys(stream)) if wrapper else None
    if template is not None:
        text = main_text(stream, template)
        if text or not template:
            return text, True
    return main_text(stream), False


def _template_texts(pages: DataFrame) -> DataFrame:
    """(host, fixed): keys of the texts that nine of ten unlike pages of a host have. Pages with the same texts count once."""

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hosts, signs, texts = [], [], []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = [key[1:] for key in text_keys(tokens(page.as_py())) if key.startswith(TEXT)]
                if held:
                    hosts.append(name)
                    signs.append(int(_digest("".join(held)), 16))
                    texts.append(np.array([int(x, 16) for x in sorted(set(held))], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(np.array(signs, np.uint64).view(np.int64)), pa.array(texts, pa.list_(pa.int64()))],
                ["host", "sign", "texts"])

    found = pages.where("html IS NOT NULL").mapInArrow(read, "host string, sign long, texts array<long>")
    unlike = stored(found.groupBy("host", "sign").agg(F.min("texts").alias("texts")), "page-texts")
    many = unlike.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= ENOUGH)
    held = unlike.select("host", F.explode("texts").alias("text")).groupBy("host", "text").agg(F.count("*").alias("n")).where(F.col("n") >= ENOUGH)
    shared = held.join(many, "host").where(F.col("n") * 10 >= F.col("pages") * TENTHS)
    key = F.concat(F.lit(TEXT), F.lpad(F.lower(F.hex("text")), 16, "0"))
    return stored(shared.groupBy("host").agg(F.array_sort(F.collect_list(key)).alias("fixed")), "template-texts")


def _shapes(pages: DataFrame) -> DataFrame:
    """(host, kind, shape, n): the unlike shapes of a kind of (host, html, fixed) and their pages; null pages have the empty shape."""

    def read(batches: Iterator[pa.RecordBatch]):
        recent: dict[tuple, str] = {}
        for batch in batches:
            seen: Counter[tuple[str, int, str]] = Counter()
            for name, page, fixed in zip(*(batch.column(i) for i in range(3))):
                page_tokens = tokens(page.as_py() or "")
                keys = _with_slots(text_keys(page_tokens), frozenset(fixed.as_py() or ()))
                stream = tuple(keys)
                found = recent.get(stream)
                if found is None:
                    found = shape(keys, {key for key in keys if key != TEXT})
                    if len(recent) > _RECENT:
                        recent.clear()
                    if len(keys) <= _SHORT:
                        recent[stream] = found
                seen[name.as_py(), kind(page_tokens), found] += 1
            hosts, kinds, shapes = zip(*seen) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(kinds, pa.int64()), pa.array(shapes, pa.string()), pa.array(list(seen.values()), pa.int64())],
                ["host", "kind", "shape", "n"])

    return pages.mapInArrow(read, "host string, kind long, shape string, n long").groupBy("host", "kind", "shape").agg(F.sum("n").alias("n"))


def learn(pages: DataFrame) -> DataFrame:
    """(host, kind, wrapper): JSON wrappers from all pages of each host, one per kind of its pages.

    Equal shapes teach once, however many pages have them. A kind's unlike shapes are aligned in
    ``PARTS`` parts, dealt by a hash, and then the parts with each other, frequent ones first; what
    comes out depends on the pages alone, not on their order. Pages that share few elements are of
    different kinds, so that a host of unlike pages (malformed urls have one) has many small wrappers.
    """
    keyed = pages.select(host(F.col("url")).alias("host"), "html")
    fixed = _template_texts(keyed)
    shapes = _shapes(keyed.join(fixed, "host", "left").select("host", "html", "fixed"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "shape"], ascending=[False, True])
        return pd.DataFrame({"host": [part["host"].iloc[0]], "kind": [part["kind"].iloc[0]], "shape": [aligned(part["shape"])], "n": [part["n"].sum()]})

    for parts in (PARTS, 1):
        shapes = shapes.groupBy("host", "kind", F.pmod(F.xxhash64("shape"), F.lit(parts))).applyInPandas(one, "host string, kind long, shape string, n long")
    texts = F.to_json(F.coalesce("fixed", F.array().cast("array<string>")))
    return stored(shapes.join(fixed, "host", "left").select("host", "kind", F.concat(F.lit("["), "shape", F.lit(", "), texts, F.lit("]")).alias("wrapper")), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, fits) for every row of ``pages`` (page_id, url, html; more columns are left out).

    ``wrappers`` (host, kind, wrapper) come from ``learn``, of these pages or others of their hosts.
    ``text`` is empty for null, empty and textless pages; of several articles all are kept, in page
    order; ``n_chars`` counts code points; ``fits`` tells whether the page matched its host's wrapper. Malformed and null urls share the
    empty host. Repeated pages come out repeated; nothing is cut.
    """

    def tell(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            kinds = [kind(tokens(page.as_py() or "")) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.int64())], [*batch.schema.names, "kind"])

    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    told = keyed.mapInArrow(tell, "page_id long, url string, html string, host string, kind long")
    joined = told.join(wrappers, ["host", "kind"], "left")

    def run(batches: Iterator[pa.RecordBatch]):
        known: dict[str, Wrapper | None] = {}
        for batch in batches:
            texts, fits = [], []
            for page, wrapper in zip(batch.column(2), batch.column(3)):
                key = wrapper.as_py()
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = Wrapper.from_json(key) if key else None
                text, fit = extracted(page.as_py(), known[key])
                texts.append(text)
                fits.append(fit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(fits, pa.bool_())],
                ["page_id", "url", "text", "n_chars", "fits"])

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, fits boolean")

"""Language identification by cross-parsing: the language whose text explains a document in the fewest phrases.

Per language a suffix automaton recognises every substring of a bounded training text. A document
is cut greedily into phrases, each the longest match from where the last one ended; the language
that needs the fewest phrases per symbol wins. Automata are flat transition tables, and many
stretches of text step through them at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

UNKNOWN = "und"
#: Bounds of training: documents and symbols per language, letters told apart, languages.
DOCUMENTS, WINDOW, SYMBOLS, LETTERS, LANGUAGES = 96, 600, 24_000, 200, 200
#: All tables together; with many languages or letters each gets less training text.
TABLE_BYTES = 96 << 20
STRETCH, CHARACTERS = 512, 1 << 22
_COUNT = 29  # bits of a transition above its target: how many phrases end with it
PAD, GAP, OTHER = 0, 1, 2


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str], alphabet: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bounds, has a letter) of lower-cased texts: letters by alphabet, anything between them one gap."""
    classes = np.where(_is_letter(), OTHER, GAP).astype(np.uint8)
    classes[[ord(c) for c in alphabet]] = np.arange(3, 3 + len(alphabet))
    lowered = [text.lower() for text in texts]
    bounds = np.concatenate([[0], np.cumsum([len(text) for text in lowered])]).astype(np.int64)
    found = classes[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = found == GAP
    keep = np.ones(len(found), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    starts = bounds[:-1][bounds[:-1] < len(found)]
    keep[starts] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(~gap)])[bounds]
    return found[keep], kept[bounds], np.diff(letters) > 0


class _Automaton:
    """Suffix automaton of a symbol sequence: from the root, exactly the paths of its substrings."""

    def __init__(self, sequence: list[int]):
        self.next, self.link, self.length, last = [{}], [-1], [0], 0
        for symbol in sequence:
            if symbol == PAD:  # texts do not run into each other
                last = 0
                continue
            last = self._extend(last, symbol)

    def _add(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, onto: int, symbol: int) -> int:
        """The state for the suffixes of ``onto`` that end after ``state``, parted from longer ones."""
        if self.length[onto] == self.length[state] + 1:
            return onto
        copy = self._add(dict(self.next[onto]), self.link[onto], self.length[state] + 1)
        while state >= 0 and self.next[state].get(symbol) == onto:
            self.next[state][symbol] = copy
            state = self.link[state]
        self.link[onto] = copy
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # known since another text
            return self._split(last, self.next[last][symbol], symbol)
        new, state = self._add({}, 0, self.length[last] + 1), last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, self.next[state][symbol], symbol)
        return new

    def table(self, width: int) -> np.ndarray:
        """Flat transitions, states as offsets: where a phrase cannot go on, the entry starts a new one from the root."""
        root = np.zeros(width, np.int32)
        for symbol, state in self.next[0].items():
            root[symbol] = state * width
        alone = (root == 0).astype(np.int32)  # an unknown symbol is a phrase of its own
        out = np.tile(root + ((1 + alone) << _COUNT), (len(self.next), 1))
        out[:, PAD] = 1 << _COUNT
        for state, edges in enumerate(self.next):
            if edges:
                out[state, list(edges)] = np.array(list(edges.values()), np.int32) * width
        out[0, 1:] = (root + (alone << _COUNT))[1:]  # at the root no phrase is open
        out[0, PAD] = 0
        return out.ravel()


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    alphabet: str
    tables: tuple[np.ndarray, ...]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """((texts, languages) phrase counts, has a letter)."""
        found, bounds, lettered = symbols(texts, self.alphabet)
        lengths = np.diff(bounds)
        stretches = -(-lengths // STRETCH)
        first = np.concatenate([[0], np.cumsum(stretches)])
        grid = np.zeros(int(first[-1]) * STRETCH, np.uint8)
        grid[np.arange(len(found)) + np.repeat(first[:-1] * STRETCH - bounds[:-1], lengths)] = found
        lines = np.ascontiguousarray(grid.reshape(-1, STRETCH).T).astype(np.int32)
        width = len(lines[0]) if len(lines) else 0
        counts = np.zeros((width, len(self.tables)), np.int32)
        for language, table in enumerate(self.tables):
            state, ended = np.zeros(width, np.int32), np.zeros(width, np.int32)
            for line in lines:
                step = table[state + line]
                ended += step >> _COUNT
                state = step & ((1 << _COUNT) - 1)
            counts[:, language] = ended + (state > 0)
        sums = np.concatenate([np.zeros((1, len(self.tables)), np.int64), np.cumsum(counts, axis=0)])
        return sums[first[1:]] - sums[first[:-1]], lettered

    def classify(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text; score is 1 - (fewest phrases / second fewest)."""
        counts, lettered = self.phrases(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        best = counts.argmin(axis=1)
        least = np.sort(counts, axis=1)
        score = 1 - least[:, 0] / np.maximum(least[:, 1], 1) if len(self.languages) > 1 else np.ones(len(texts))
        named = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return named, np.where(lettered, np.clip(score, 0, 1), 0.0).tolist()


def fit(samples: dict[str, list[str]]) -> Model:
    """A model of languages in alphabetical order from some texts of each."""
    languages = tuple(sorted(samples))
    frequency: dict[str, int] = {}
    for texts in samples.values():
        for text in texts:
            for c in text.lower():
                if c.isalpha():
                    frequency[c] = frequency.get(c, 0) + 1
    alphabet = "".join(sorted(sorted(frequency, key=lambda c: (-frequency[c], c))[:LETTERS]))
    width = 3 + len(alphabet)
    budget = min(SYMBOLS, TABLE_BYTES // (8 * width * max(1, len(languages))))
    tables = []
    for language in languages:
        sequence: list[int] = []
        for text in samples[language]:
            if len(sequence) >= budget:
                break
            sequence += [*symbols([text], alphabet)[0][: budget - len(sequence)].tolist(), PAD]
        tables.append(_Automaton(sequence).table(width))
    return Model(languages, alphabet, tuple(tables))


def train(docs: DataFrame) -> Model:
    """Learn from (doc_id, text, lang): rows with a null text or lang, or a lang of ``und``, teach nothing.

    Unlike documents are counted per language first; then about ``DOCUMENTS`` of each are drawn by a
    hash of id and text, a stretch of at most ``WINDOW`` characters from the middle of each. Equal
    rows are one document, and an id that many rows share, or null, draws no more than another. The
    driver gets at most 2 * ``DOCUMENTS`` stretches for each of at most ``LANGUAGES`` languages (the
    most frequent).
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    hashed = F.xxhash64("doc_id", "text")
    counts = (known.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct(hashed).alias("unlike"))
              .orderBy(F.col("rows").desc(), "lang").limit(LANGUAGES).collect())
    if not counts:
        return fit({})
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], DOCUMENTS / max(1, r["unlike"]))])
    ticket = F.pmod(hashed, F.lit(1 << 40)) / F.lit(1 << 40)
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - WINDOW) / 2)).cast("int"), F.lit(WINDOW))
    chosen = known.where(ticket < share[F.col("lang")]).select("lang", middle.alias("text"), ticket.alias("ticket"))
    once = chosen.groupBy("lang", "ticket").agg(F.min("text").alias("text"))  # copies go before rows of a language meet
    first = F.row_number().over(Window.partitionBy("lang").orderBy("ticket"))
    drawn = once.withColumn("at", first).where(F.col("at") <= 2 * DOCUMENTS).collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(drawn, key=lambda r: (r["lang"], r["ticket"], r["text"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return fit({lang: texts for lang, texts in samples.items() if any(c.isalpha() for t in texts for c in t)})


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` plus language and score, which replace columns of these ``names``.

    ``score`` lies between 0 (two languages fit alike) and 1. A null text, a text without a letter
    and any text under a model without languages are ``und`` with score 0. Ties go to the
    alphabetically first language. Whole texts are parsed, in stretches of ``STRETCH`` symbols; a
    phrase ends at a stretch's end, for every language alike.
    """
    kept = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TABLE_BYTES
    at = kept.columns.index("text")

    def label(batches):
        model = shared.value
        for batch in batches:
            texts, labels, scores, waiting, held = batch.column(at), [], [], [], 0
            for i, text in enumerate(texts):
                waiting.append(text.as_py() or "")
                held += len(waiting[-1])
                if held >= CHARACTERS or i == len(texts) - 1:
                    found = model.classify(waiting)
                    labels += found[0]
                    scores += found[1]
                    waiting, held = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, *names])

    schema = kept.withColumns({names[0]: F.lit("").cast("string"), names[1]: F.lit(0.0)}).schema
    return kept.mapInArrow(label, schema)

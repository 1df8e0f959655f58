"""Collocations, the Jaccard join and the source audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
from arborscan.llm import buffers, collocations, divergence, fragments

LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_blocks_keep_keys_and_values():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << buffers.KEY_BITS, 5000).astype(np.uint64))
    values = draw.integers(-(1 << 62), 1 << 62, len(keys))
    for slices in (1, 3, 12, 211, 65536):
        bounds = buffers.slice_bounds(slices)
        assert bounds[0] == 0 and bounds[-1] == 1 << buffers.KEY_BITS and (np.diff(bounds.astype(np.int64)) > 0).all()
        parts = [(s, *buffers.unpacked(b)) for s, b in buffers.sliced(keys, values, slices)]
        assert (np.concatenate([k for _, k, _ in parts]) == keys).all() and (np.concatenate([v for _, _, v in parts]) == values).all()
        assert all(bounds[s] <= k.min() and k.max() < bounds[s + 1] for s, k, _ in parts)


# ---- phrases -------------------------------------------------------------------------------------------------------------------------

def phrases_by_hand(docs, min_count, longest, share, top):
    counts, size = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            size[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i: i + k])] += 1
    out = []
    for lang, found in counts.items():
        kept = {p: f for p, f in found.items() if len(p) > 1 and f >= min_count}
        rows = []
        for p, a in kept.items():
            inside = [f for q, f in kept.items() if len(q) > len(p) and any(q[i: i + len(p)] == p for i in range(len(q)))]
            if any(100 * f >= share * a for f in inside):
                continue
            cut = min((1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            rows.append((-cut[0], -a, " ".join(p).encode(), cut[2], cut[3]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, size[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("min_count,longest,top,parts", [(3, 3, 2000, 3), (2, 4, 15, 1), (5, 2, 2000, 7)])
def test_collocations_match_brute_force(spark, min_count, longest, top, parts):
    draw = random.Random(min_count)
    words = ["the", "The", "of", "é", "日本", "a'b", "x"] + [f"w{i}" for i in range(12)]
    docs = [(draw.choice(["", "."]).join(draw.choice(words) + draw.choice([" ", " ", "\t ", ", ", "\n", "! "]) for _ in range(draw.randrange(60))),
             draw.choice(["en", "en", "de", None])) for _ in range(120)]
    docs += [("New York City is big", "en")] * 9 + [("New York is", "en")] * 4 + [(None, "en"), ("", None), (" \t.", "fr"), (LONG, "long")]
    rows = spark.createDataFrame([(t, l, 1, "z") for t, l in docs], "text string, lang string, f int, w1 string").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = collocations.mine(rows, min_count, longest, 50, top).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got)) == phrases_by_hand(docs, min_count, longest, 50, top)


def test_collocations_of_odd_tables(spark):
    schema = "text string, lang string"
    assert collocations.mine(spark.createDataFrame([], schema)).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "en"), ("...", "en")], schema), 1).count() == 0
    one = collocations.mine(spark.createDataFrame([("a b", None)] * 30, schema)).collect()
    assert [tuple(r) for r in one] == [("und", 1, "a b", 30, 30, 30, 60, 1_000_000)]


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000
    row = spark.createDataFrame([(big, big, big)], "a long, l long, r long")
    assert row.select(collocations._cut(collocations.F.lit(1), collocations.F.col("l"), collocations.F.col("r"))["score"]).first()[0] == 1_000_000


# ---- Jaccard join --------------------------------------------------------------------------------------------------------------------

def word_set(text, words):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i: i + words]) for i in range(len(found) - words + 1)}


def components(docs, words, similarity):
    sets = [(i, word_set(t, words)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                high, low = sorted((root(i), root(j)), reverse=True)
                parent[high] = low
    return sorted((i, len(x), root(i)) for i, x in sets)


def family(seed, count, words, changes):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(draw.randrange(changes + 1)):
            own[draw.randrange(words)] = f"x{draw.randrange(40)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("words,similarity,held", [(3, 90, 1 << 20), (3, 80, 200), (2, 95, 50), (1, 100, 1 << 20)])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, words, similarity, held):
    monkeypatch.setattr(fragments, "_HELD", held)  # many blocks
    monkeypatch.setattr(fragments, "_TOGETHER", 3)
    texts = family(1, 40, 120, 8) + family(2, 25, 60, 3) + family(3, 30, 200, 12) + ["one two"] * 3 + ["ONE\ttwo", "İ one two", "a", "", None, "  \n", LONG, LONG + " end"]
    common = " ".join(f"often{i}" for i in range(30))
    texts += [f"{common} unlike text number {i} with words {i * 7}" for i in range(20)] + [common + f" {i}" for i in range(12)]
    random.Random(4).shuffle(texts)
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, component_id string, s int").repartition(3)
    got = fragments.groups(rows, words, similarity).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(docs, words, similarity)


def test_jaccard_join_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fragments.groups(spark.createDataFrame([], schema)).count() == 0
    far, near = "a b c d e f g h", "p q r s t u v w"
    rows = [(None, far), (None, None), (9, far), (9, near), (9, near), (4, near), (2, far), (7, None), (1, "lone text it is")]
    got = fragments.groups(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == sorted(
        [(-1, 6, None), (-1, 0, None), (9, 6, 2), (9, 6, 2), (9, 6, 2), (4, 6, 2), (2, 6, 2), (7, 0, 7), (1, 2, 1)], key=lambda r: (r[0], r[1], r[2]))


# ---- source audit --------------------------------------------------------------------------------------------------------------------

def audit_by_hand(docs, min_docs, top):
    counts, holds, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        holds[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, d in holds[lang].items() if d >= min_docs)
        own = [s for g, s in sorted(groups) if g == lang]
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in own}, shares(whole)
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,terms", [(256, 8192), (2, 3)])
def test_audit_matches_brute_force(spark, monkeypatch, block, terms):
    monkeypatch.setattr(divergence, "_BLOCK", block)
    monkeypatch.setattr(divergence, "_TERMS", terms)
    draw = random.Random(block)
    words = ["the", "The", "word", "überlang" * 3, "überlang" * 3 + "er", "日本語", "abcdefgh", "abcdefghi", "abcdefg", "x1y2", "don't", "z"]
    docs = [(" ".join(draw.choice(words) for _ in range(draw.randrange(30))), draw.choice(["en", "de", None]), draw.choice(["a", "a", "b", "c", "é", None]))
            for _ in range(200)]
    docs += [("only here", "fr", "one"), (None, "fr", "two"), ("12 34", "fr", "one"), ("many\tmany", None, "silent"), (LONG, "long", "l"), ("", "en", "empty")]
    rows = spark.createDataFrame([(*d, 1, "k") for d in docs], "text string, lang string, source string, rank int, item string").repartition(3)
    assert sorted(map(tuple, divergence.audit(rows, 10).collect())) == audit_by_hand(docs, 10, 10)
    assert divergence.audit(rows.limit(0)).count() == 0


def test_pointer_sort_orders_terms():
    draw = random.Random(3)
    terms = ["".join(draw.choice("ab") for _ in range(draw.choice([1, 7, 8, 9, 16, 17, 40]))).encode() for _ in range(2000)]
    data = np.frombuffer(b" ".join(terms), np.uint8)
    lengths = np.array([len(t) for t in terms])
    starts = np.cumsum(lengths + 1) - lengths - 1
    order, run = divergence.pointer_sort(data, starts, lengths)
    want = sorted(range(len(terms)), key=lambda i: (terms[i], i))
    assert order.tolist() == want
    assert run.tolist() == [sorted(set(terms)).index(terms[i]) for i in want]


def test_strings_of_byte_ranges():
    data = np.frombuffer("añb c".encode(), np.uint8)
    assert buffers.strings(data, np.array([0, 5]), np.array([4, 1])).to_pylist() == ["añb", "c"]
    assert len(buffers.hashes(pa.array([], pa.string()))) == 0


def test_new_queries_are_registered():
    assert {"op11", "op12", "op13"} <= {n.split("_")[0] for n in contract.queries()}

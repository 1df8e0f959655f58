"""Phrase collocations from sorted count streams.

The layout is that of external-memory estimation: the count stream of phrases of every length is kept twice, sorted
by first words (prefix order) and by last words (suffix order). In prefix order a phrase follows
its own beginnings, so one pass over the merged streams of all lengths hands every phrase the
counts of its beginnings and every phrase the largest count of its extensions to the right; in
suffix order the same pass gives ends and extensions to the left. Nothing is looked up by hash.

Only phrases that reach the least count need a place in the streams. A first pass writes sorted
blocks of phrase keys and adds them up by slice of the key range; keys that reach the count set bits
of a map of fixed size, and the second pass counts the phrases whose bit is set by their words. Keys that
share a bit let a rare phrase through to the exact count, never the other way round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborscan.llm import buffers
from arborscan.llm.common import parallelism, stored
from arborscan.llm.shingles import mixed

MIN_COUNT, LONGEST, SHARE, TOP = 10, 3, 50, 2000
SCALE = 1_000_000
MAP_BITS, KEY_BITS = 27, 40  # the map of frequent keys has 2 ** MAP_BITS bits, 16 MB; bits of a key
_COMPACT = 1 << 22  # keys of a slice that wait until they are added up

#: Bytes that part pieces, and bytes that part words inside a piece.
_STOP, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACE[list(b" \t")] = True


class _Phrases:
    """The phrases of some texts of one language: word numbers in order, and where phrases of each length start."""

    def __init__(self, lang: str, data: np.ndarray, bounds: np.ndarray):
        data = buffers.LOWER[data]
        stop = _STOP[data]
        starts, ends = buffers.runs(~(stop | _SPACE[data]), bounds)
        self.words, self.known = buffers.numbered(data, starts, ends - starts)
        before = np.concatenate([[0], np.cumsum(stop)])[starts] if len(starts) else np.zeros(0, np.int64)
        self.piece = before + np.searchsorted(bounds, starts, "right")
        seed = buffers.hashes(pa.array([lang], pa.string()))[0]
        self.hash = mixed(buffers.hashes(self.known) + seed)[self.words]

    def keys(self, longest: int):
        """(length, starts, keys) of the phrases of every length."""
        joined = mixed(self.hash)
        for length in range(1, longest + 1):
            n = max(0, len(self.words) - length + 1)
            joined = joined[:n]
            if length > 1:
                joined = mixed(joined * np.uint64(2 * length + 1) + self.hash[length - 1:])
            starts = np.flatnonzero(self.piece[:n] == self.piece[length - 1:]) if length > 1 else np.arange(n)
            yield length, starts, joined[starts] >> np.uint64(64 - KEY_BITS)


def _by_language(batch: pa.RecordBatch):
    """The phrases of a batch (lang, text), some texts of one language at a time."""
    coded = batch.column(0).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        column = batch.column(1) if len(coded.dictionary) == 1 else batch.column(1).take(pa.array(np.flatnonzero(numbers == k)))
        for _, _, data, bounds in buffers.parts(column, 6 << 20):
            yield lang, _Phrases(lang, data, bounds)


def _frequent_keys(texts: DataFrame, min_count: int, longest: int) -> bytearray:
    """Map of the keys (their first MAP_BITS bits) that occur at least ``min_count`` times."""
    slices = min(parallelism(texts.sparkSession), 1 << 16)
    bounds = buffers.slice_bounds(slices, KEY_BITS)
    shift = np.uint64(KEY_BITS - MAP_BITS)

    def blocks(batches):
        for batch in batches:
            for _, phrases in _by_language(batch):
                keys, counts = np.unique(np.concatenate([k for _, _, k in phrases.keys(longest)]), return_counts=True)
                found = list(buffers.sliced(keys, np.minimum(counts, min_count), slices, KEY_BITS))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())],
                                                 ["slice", "block"])

    def total(keys, counts):
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[firsts], np.minimum(np.add.reduceat(counts, firsts), min_count)

    def marked(number, keys, counts):
        keys, counts = total(keys, counts)
        low, high = (int(b >> shift) for b in bounds[number: number + 2])
        bits = np.zeros(high - low, np.uint8)
        bits[(keys[counts >= min_count] >> shift).astype(np.int64) - low] = 1
        return pa.RecordBatch.from_pydict({"first": pa.array([low // 8], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def add(batches):
        number, keys, counts, waiting = None, [], [], 0
        for batch in batches:
            for own, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != number:
                    if number is not None:
                        yield marked(number, keys, counts)
                    number, keys, counts, waiting = own, [], [], 0
                found = buffers.unpacked(block.as_py())
                keys.append(found[0])
                counts.append(found[1])
                waiting += len(found[0])
                if waiting > max(_COMPACT, 2 * len(keys[0])):
                    a, b = total(keys, counts)
                    keys, counts, waiting = [a], [b], len(a)
        if number is not None:
            yield marked(number, keys, counts)

    dealt = texts.mapInArrow(blocks, "slice int, block binary").repartition(slices, "slice").sortWithinPartitions("slice")
    out = bytearray(1 << (MAP_BITS - 3))
    for row in dealt.mapInArrow(add, "first long, bits binary").collect():  # the parts of the map, 16 MB in all
        out[row["first"]: row["first"] + len(row["bits"])] = row["bits"]
    return out


def _words(longest: int) -> list[str]:
    return [f"w{i}" for i in range(1, longest + 1)]


def grams(docs: DataFrame, min_count: int, longest: int) -> DataFrame:
    """(lang, w1, w2, ..., f): phrases of up to ``longest`` words that occur at least ``min_count`` times in a language.

    The row of a language without words has the number of all its words.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    frequent = texts.sparkSession.sparkContext.broadcast(bytes(_frequent_keys(texts, min_count, longest)))
    names, shift = ["lang", *_words(longest), "f"], np.uint64(KEY_BITS - MAP_BITS)

    def count(batches):
        bits = np.frombuffer(frequent.value, np.uint8)
        for batch in batches:
            for lang, phrases in _by_language(batch):
                n = len(phrases.known)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *[pa.array([None], pa.string())] * longest,
                                                  pa.array([len(phrases.words)], pa.int64())], names)
                for length, starts, keys in phrases.keys(longest):
                    place = keys >> shift
                    likely = bits[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    starts = starts[likely]
                    code, firsts = phrases.words[starts], None
                    for k in range(1, length):  # numbers stay below texts' words times their distinct words
                        _, code = np.unique(code, return_inverse=True)
                        code = code * n + phrases.words[starts + k]
                    _, firsts, counts = np.unique(code, return_index=True, return_counts=True)
                    at = starts[firsts]
                    columns = [phrases.known.take(pa.array(phrases.words[at + k])) if k < length else pa.nulls(len(at), pa.string())
                               for k in range(longest)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(at), np.int32))), *columns,
                                                      pa.array(counts.astype(np.int64))], names)

    schema = ", ".join(f"{name} {'long' if name == 'f' else 'string'}" for name in names)
    counted = texts.mapInArrow(count, schema).groupBy(*names[:-1]).agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= min_count) | F.col("w1").isNull())


def lockstep(counted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One pass over the count streams of all lengths, merged in the order of ``keys``.

    Adds ``name``, the counts of the phrase's beginnings in this order (those of one key, two keys,
    ...), and ``extended``, the largest count of a phrase that goes on by one more key. The stream is cut
    into slices that end between groups of two equal keys, each merged on its own; the count of
    a one-key phrase that stands in an earlier slice is carried over.
    """
    longest = len(keys)
    length = sum((F.col(k).isNotNull().cast("int") for k in keys), F.lit(0))
    cut = counted.where(F.col(keys[0]).isNotNull()).repartitionByRange(parallelism(counted.sparkSession), "lang", *keys[:2])
    stream = stored(cut.select("*", length.alias("length"), F.spark_partition_id().alias("slice")), f"{name}-order")
    last = stream.where("length = 1").groupBy("slice").agg(F.max_by("f", F.struct("lang", keys[0])).alias("f"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    carried = stream.select("slice").distinct().join(last, "slice", "left").select("slice", F.last("f", True).over(before).alias("carried"))
    merged = Window.partitionBy("slice").orderBy("lang", *[F.asc_nulls_first(k) for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
    beginnings = [F.last(F.when(F.col("length") == d, F.col("f")), True).over(merged) for d in range(1, longest)]
    beginnings[0] = F.coalesce(beginnings[0], F.col("carried"))
    extended = F.lit(None).cast("long")
    for d in range(2, longest):
        group = Window.partitionBy("slice", "lang", *keys[:d])
        extended = F.when(F.col("length") == d, F.max(F.when(F.col("length") == d + 1, F.col("f"))).over(group)).otherwise(extended)
    return stream.join(carried, "slice").select("lang", *keys, "f", F.array(*beginnings).alias(name), extended.alias("extended"))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of every language whose words stand together most.

    ``docs`` has (text, lang); null texts are empty, a null lang is 'und', more columns are left
    out, rows that repeat count as often as they stand. Texts (A-Z lower-cased) fall into pieces at
    ``.,;:!?`` and line ends, pieces into words at blanks and tabs; phrases of 2 to ``longest`` words lie within a piece. A phrase of
    count ``a`` of at least ``min_count`` is scored by its worst cut into a beginning of count ``l``
    and an end of count ``r``: floor(1,000,000 * a * a / (l * r)), ties to the first cut; integers of
    38 digits hold the products. A phrase inside a longer one that has at least ``share`` percent of its occurrences is
    left out. The first ``top`` of a language by score, then ``a``, descending, then phrase; ``n`` is
    the number of all its words. An empty table gives an empty result.
    """
    if longest < 2:
        raise ValueError("phrases have at least two words")
    words = _words(longest)
    counted = stored(grams(docs, min_count, longest), "grams")
    sizes = counted.where(F.col("w1").isNull()).select("lang", F.col("f").alias("n"))
    phrase, length = F.array_join(F.array(*words), " "), sum((F.col(w).isNotNull().cast("int") for w in words), F.lit(0))
    ends = [f"e{k}" for k in range(1, longest + 1)]
    backwards = counted.select("lang", "f", *[_from_end(words, k).alias(e) for k, e in enumerate(ends, 1)])
    left = lockstep(counted, words, "beginnings").select("lang", phrase.alias("phrase"), length.alias("length"), F.col("f").alias("a"), "beginnings", "extended")
    ahead = F.array_join(F.reverse(F.array(*ends)), " ")
    right = lockstep(backwards, ends, "ends").where(F.col("e2").isNotNull()).select("lang", ahead.alias("phrase"), "ends", F.col("extended").alias("extended_left"))
    both = left.where("length > 1").join(right.hint("merge"), ["lang", "phrase"])
    whole = both.where(F.coalesce(100 * F.greatest("extended", "extended_left") < share * F.col("a"), F.lit(True)))
    cuts = F.transform(F.sequence(F.lit(1), F.col("length") - 1), lambda k: _cut(
        k, F.element_at("beginnings", k), F.element_at("ends", F.col("length") - k)))
    scored = whole.select("lang", "phrase", "a", F.array_min(cuts).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within hash buckets, so that no task orders all phrases of a language
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(parallelism(docs.sparkSession)))
    few = scored.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _from_end(words: list[str], k: int) -> Column:
    """The k-th word from the end, null if the phrase is shorter."""
    filled = F.filter(F.array(*words), lambda w: w.isNotNull())
    return F.get(F.reverse(filled), F.lit(k - 1))


def _cut(k: Column, l: Column, r: Column) -> Column:
    wide = "decimal(38,0)"
    a = F.col("a").cast(wide)
    score = F.call_function("div", F.lit(SCALE).cast(wide) * a * a, l.cast(wide) * r.cast(wide)).cast("long")
    return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

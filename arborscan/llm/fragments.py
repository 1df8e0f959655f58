"""N-gram Jaccard join by vertical partitioning.

All shingles have one global order, rare ones first. The order is cut into fragments; a document's
set falls into one segment per fragment, the overlap of a pair is counted fragment by fragment and the
partial overlaps are summed per pair. Three steps keep the pairs few without losing a link:

* Sets. Equal sets are one, represented by their smallest id. A set can only link if at least the share
  of its shingles that the similarity asks for occurs in another set too. What occurs twice is found from sorted blocks
  of shingle keys, added up by slice of the key range.
* Prefixes. Two similar sets share one of their first shingles in the global order (as many as may
  differ, and one). Sets that share such a shingle form a bucket; every member is measured against the bucket's pivot, the set
  with the smallest share of shingles of its own.
* Distances. One minus the similarity is a metric: two members of a pivot's group whose distances
  from it differ by more than links allow cannot link. Members that are neither linked with the pivot nor connected by now
  meet only members in reach, with which they share a prefix shingle and whose prefixes leave enough to share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from arborscan.llm import buffers, shingles
from arborscan.llm.common import parallelism, stored
from arborscan.llm.shingles import mixed
from arborscan.operators.components import connected_components

WORDS, SIMILARITY, FRAGMENTS = 3, 90, 8
_TOGETHER = 64  # pairs that pass one copy of a pivot's segments
_HELD = 1 << 20  # shingles of a block


def _digested(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2): size and 128-bit digest of every document's shingle set."""

    def profile(batches):
        for batch in batches:
            sizes, digests = [], []
            for found in shingles.sets(batch.column(1), words):
                sizes.append(len(found))
                digests.append(_digested(found))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                                             ["doc_id", "n_shingles", "d1", "d2"])

    return _texts(docs).mapInArrow(profile, "doc_id long, n_shingles long, d1 long, d2 long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _occurrences(keys: np.ndarray, owners: np.ndarray):
    """Postings sorted by key, the first posting of every key and the keys that occur once; the last bit of a key is no part of it."""
    order = np.argsort(keys)
    keys, owners = keys[order], owners[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] >> np.uint64(1) != keys[:-1] >> np.uint64(1)
    return keys, owners, first, first & np.append(first[1:], True)


def repeated(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, repeated): how many shingles of a document may occur in another set too, never too few.

    A block holds the keys of some documents' sets, of equal sets only one. Keys that sets of a block share are known
    there and then; one posting of every key goes to its slice of the key range, marked in the
    last bit if it is known already, and meets the equal keys of other blocks. A shingle of all
    documents thus sends one posting per block.
    """
    slices = min(parallelism(docs.sparkSession), 1 << 16)
    owners_in = max(1, slices // 8)  # tallies travel as blocks too, one per slice and bucket of documents
    shift, one = np.uint64(64 - buffers.KEY_BITS + 1), np.uint64(1)

    def tallied(owners):
        found, n = np.unique(owners, return_counts=True)
        bucket = (mixed(found.view(np.uint64)) % np.uint64(owners_in)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, n, cuts = found[order], n[order], np.searchsorted(bucket[order], np.arange(owners_in + 1))
        filled = np.flatnonzero(np.diff(cuts))
        bodies = [buffers.packed(found[cuts[k]: cuts[k + 1]].view(np.uint64), n[cuts[k]: cuts[k + 1]]) for k in filled]
        return pa.RecordBatch.from_arrays([pa.nulls(len(filled), pa.int32()), pa.array(bodies, pa.binary()), pa.array(filled, pa.int32())],
                                          ["slice", "block", "bucket"])

    def block(ids, sets):
        different = {_digested(own): k for k, own in enumerate(sets) if len(own)}
        if not different:
            return
        kept = sorted(different.values())
        keys = np.concatenate([sets[k] for k in kept]) >> shift << one
        keys, owners, first, alone = _occurrences(keys, np.repeat(ids[kept], [len(sets[k]) for k in kept]))
        yield tallied(owners[~alone])
        sent = list(buffers.sliced(keys[first] | (~alone[first]).astype(np.uint64), owners[first], slices))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in sent], pa.int32()), pa.array([b for _, b in sent], pa.binary()),
                                          pa.nulls(len(sent), pa.int32())], ["slice", "block", "bucket"])

    def blocks(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets, held, start = [], 0, 0
            for i, own in enumerate(shingles.sets(batch.column(1), words), 1):
                sets.append(own)
                held += len(own)
                if held > _HELD or i == len(ids):
                    yield from block(ids[start:i], sets)
                    sets, held, start = [], 0, i

    def meet(postings):
        keys, owners, _, alone = _occurrences(*map(np.concatenate, zip(*postings)))
        return tallied(owners[~alone & (keys & one == 0)]).select(["block", "bucket"])

    def add(batches):
        number, postings = None, []
        for batch in batches:
            place = batch.column(0).to_pylist()
            for own, body in zip(place, batch.column(1)):
                if own is None:
                    continue
                if own != number and number is not None:
                    yield meet(postings)
                    postings = []
                number = own
                postings.append(buffers.unpacked(body.as_py()))
            yield batch.select(["block", "bucket"]).take(pa.array([i for i, own in enumerate(place) if own is None], pa.int64()))
        if number is not None:
            yield meet(postings)

    def summed(batches):
        bucket, tallies = None, []

        def result():
            owners, n = (np.concatenate(x) for x in zip(*tallies))
            found, number = np.unique(owners, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, number, n)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], ["doc_id", "repeated"])

        for batch in batches:
            for body, own in zip(batch.column(0), batch.column(1).to_pylist()):
                if own != bucket and bucket is not None:
                    yield result()
                    tallies = []
                bucket = own
                tallies.append(buffers.unpacked(body.as_py()))
        if bucket is not None:
            yield result()

    sent = _texts(docs).where("doc_id IS NOT NULL").mapInArrow(blocks, "slice int, block binary, bucket int")
    dealt = sent.withColumn("to", F.coalesce("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"))).repartition(slices, "to").drop("to")
    met = dealt.sortWithinPartitions("slice").mapInArrow(add, "block binary, bucket int")
    return met.repartition(owners_in, "bucket").sortWithinPartitions("bucket").mapInArrow(summed, "doc_id long, repeated long")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(s, shingles) of the ``wanted`` sets (doc_id, d1, d2, n); ``s`` names a set by the id, first digest and size."""

    def hashed(batches):
        for batch in batches:
            sets = list(shingles.sets(batch.column(1), words))
            halves = np.frombuffer(b"".join(map(_digested, sets)), "<i8").reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), lists],
                                             ["doc_id", "d1", "d2", "shingles"])

    texts = _texts(docs).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = texts.mapInArrow(hashed, "doc_id long, d1 long, d2 long, shingles array<long>").join(wanted, ["doc_id", "d1", "d2"])
    return found.dropDuplicates(["doc_id", "d1", "d2"]).select(F.struct(F.col("doc_id").alias("id"), F.col("d1").alias("d"), "n").alias("s"), "shingles")


def segments(sets: DataFrame, similarity: int, fragments: int) -> tuple[DataFrame, DataFrame]:
    """(s, fragment, shingles) of sets that may still link, and (s, own, prefix): the number of shingles of their own, and the others (df, x) of the prefix.

    Only shingles of two or more sets are listed; the others come first in the global order and
    overlap with nothing. Fragments hold about equal numbers of postings.
    """
    postings = sets.select("s", F.explode("shingles").alias("x"))
    frequent = postings.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    listed = stored(postings.join(frequent, "x"), "postings")
    place = F.col("df") + F.col("x") / F.lit(2.0 ** 64) + 0.5
    cuts = listed.agg(F.percentile_approx(place, [k / fragments for k in range(1, fragments)], F.lit(10_000))).first()[0] or []
    size, required = F.col("s.n"), F.ceil(F.col("s.n") * similarity / 100)
    lines = listed.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("line"))
    unshared = size - F.size("line")
    prefix = F.slice("line", 1, F.greatest(size - required + 1 - unshared, F.lit(0)).cast("int"))
    heads = lines.select("s", unshared.cast("long").alias("own"), prefix.alias("prefix")).where(F.size("prefix") > 0)
    heads = stored(heads, "prefixes")
    fragment = sum((F.when(place >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    cut = listed.join(heads.select("s"), "s").groupBy("s", fragment.alias("fragment")).agg(F.collect_list("x").alias("shingles"))
    return stored(cut, "segments"), heads


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """(a, b, common) of distinct pairs (a, b): overlaps of their segments, counted per fragment and summed per pair.

    The pairs of one ``a`` are dealt to parts of about ``_TOGETHER``, each with a copy of its segments.
    """
    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / _TOGETHER).cast("int").alias("parts"))
    dealt = pairs.join(sized, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    of_b = dealt.join(cut.select(F.col("s").alias("b"), "fragment", F.col("shingles").alias("of_b")), "b")
    of_a = sized.join(cut.select(F.col("s").alias("a"), "fragment", F.col("shingles").alias("of_a")), "a").select(
        "a", "fragment", "of_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    partial = of_b.join(of_a, ["a", "part", "fragment"]).select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("partial"))
    return partial.groupBy("a", "b").agg(F.sum("partial").alias("common"))


def _reachable(common: Column, similarity: int) -> Column:
    """Whether sets r and m with at most this overlap may be similar."""
    return 100 * common >= similarity * (F.col("r.s.n") + F.col("m.s.n") - common)


def _most_common() -> Column:
    """The most shingles r and m can share by their prefixes: up to the earlier end of the two, all shingles of both are known."""
    ends = F.least(F.element_at("r.prefix", -1), F.element_at("m.prefix", -1))
    rest = [F.col(f"{side}.s.n") - F.col(f"{side}.own") - F.size(F.filter(f"{side}.prefix", lambda e: e <= ends)) for side in "rm"]
    return F.size(F.array_intersect("r.prefix", "m.prefix")) + F.least(*rest)


def links(cut: DataFrame, heads: DataFrame, similarity: int) -> DataFrame:
    """Links (src, dst) of ids that connect all similar sets."""
    similar = 100 * F.col("common") >= similarity * (F.col("a.n") + F.col("b.n") - F.col("common"))
    buckets = heads.select("s", (F.col("own") / F.col("s.n")).alias("own"), F.explode("prefix.x").alias("x"))
    shared = buckets.groupBy("x").agg(F.min(F.struct("own", "s")).alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = stored(buckets.join(shared.select("x", F.col("first.s").alias("a")), "x").where("s <> a").select("a", F.col("s").alias("b")).distinct(), "pairs")
    distance = 1 - F.col("common") / (F.col("a.n") + F.col("b.n") - F.col("common"))
    measured = stored(overlaps(pairs, cut).select("a", "b", similar.alias("similar"), distance.alias("distance")), "measured")
    first = measured.where("similar").select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    labels = connected_components(first)
    apart = 1 - similarity / 100 + 1e-6
    members = (measured.join(labels.withColumnRenamed("node", "_id"), F.col("b.id") == F.col("_id"), "left").join(heads.withColumnRenamed("s", "b"), "b")
               .select("a", F.col("b").alias("s"), "similar", "distance", F.coalesce("component", "b.id").alias("label"), "own", "prefix",
                       F.floor(F.col("distance") / apart).alias("cell")))
    near = members.where("NOT similar").withColumn("cell", F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)))
    r, m = near.alias("r"), members.alias("m")
    may = ((F.col("r.label") != F.col("m.label")) & (F.col("m.similar") | (F.col("r.s") < F.col("m.s")))
           & (F.abs(F.col("r.distance") - F.col("m.distance")) <= apart)
           & _reachable(F.least(F.col("r.s.n") - F.col("r.own"), F.col("m.s.n") - F.col("m.own")), similarity)
           & F.arrays_overlap("r.prefix", "m.prefix") & _reachable(_most_common(), similarity))
    more = r.join(m, (F.col("r.a") == F.col("m.a")) & (F.col("r.cell") == F.col("m.cell")) & may)
    more = stored(more.select(F.least("r.s", "m.s").alias("a"), F.greatest("r.s", "m.s").alias("b")).distinct(), "pairs")
    second = overlaps(more, cut).where(similar).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    return first.unionByName(stored(second, "links"))


def groups(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; more columns are left out).

    ``component_id`` is the smallest id reachable over links of documents whose shingle sets have
    100 * intersection >= similarity * union. Documents without words (null, empty, white space)
    link with nothing. Rows of one id are one document: every text of it is compared, and they share a component. A row
    without an id has no component. An empty table gives an empty one. Shingles are 64-bit hashes.
    """
    found = stored(profiles(docs, words), "profiles")
    real = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = real.join(repeated(docs, words), "doc_id", "left").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("class_id"), F.max("n_shingles").alias("n"), F.max("repeated").alias("repeated"))
    sets = stored(sets, "sets")
    likely = sets.where(100 * F.col("repeated") >= similarity * F.col("n")).select(F.col("class_id").alias("doc_id"), "d1", "d2", "n")
    cut, heads = segments(_sets_of(docs, likely, words), similarity, fragments)
    of_row = real.join(sets.select("d1", "d2", "class_id"), ["d1", "d2"])
    same = of_row.groupBy("doc_id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high")
    of_id = of_row.join(same, "doc_id", "left_semi").select(F.col("class_id").alias("src"), F.col("doc_id").alias("dst"))
    labels = connected_components(links(cut, heads, similarity).unionByName(of_id))
    named = sets.select("d1", "d2", F.col("class_id").alias("node")).join(labels, "node", "left").select(
        "d1", "d2", F.coalesce("component", "node").alias("component"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return found.join(named, ["d1", "d2"], "left").select("doc_id", "n_shingles", component.alias("component_id"))

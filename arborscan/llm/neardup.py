"""Near-duplicate groups: circulant MinHash, banding, exact Jaccard on full sets, connected components.

Documents with equal shingle sets are one class, represented by its smallest id, before anything
is compared. In a bucket of representatives not all pairs are compared. First every member meets
the bucket's pivot, its smallest id; in a group of copies most link with it and need no more. The
buckets of one pivot then form a group, and the members that did not link with the pivot meet all
others of the group, many at a time: a block of them is indexed by shingle and the group's members
stream past it, once per block. After that every pair of a bucket has been compared or is known to
be connected, so no link between different components is lost, and no pairs are written out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborscan.llm import shingles
from arborscan.llm.common import stored
from arborscan.operators.components import connected_components

WORDS, SIMILARITY = 5, 80  # of stages without a contract of their own; similarity in hundredths
BANDS, ROWS = 32, 5
_TOGETHER, _BLOCK, _STRIPE = 256, 256, 512  # members that pass one copy of their pivot; members in one index; members that pass one copy of an index

_PROFILE = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands): set size, a 128-bit digest of the set and the MinHash band keys."""

    def profile(batches):
        hashing = shingles.circulant(BANDS * ROWS)
        for batch in batches:
            sizes, digests, signatures, filled = [], [], [], []
            for found in shingles.sets(batch.column(1), words):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                filled.append(len(found) > 0)
                if len(found):
                    signatures.append(hashing.signature(found))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            keys = hashing.bands(np.array(signatures), BANDS).ravel() if signatures else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(filled, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), bands],
                ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(profile, _PROFILE)


def _streamed(rows: DataFrame, texts: DataFrame, compare) -> DataFrame:
    """``compare`` over (one, part, role, doc_id, label, text), sorted: what is looked at first, then what streams past it."""
    lined = (rows.join(texts, "doc_id").select("one", "part", "role", "doc_id", "label", "text")
             .repartition("one", "part").sortWithinPartitions("one", "part", "role"))
    return lined.mapInArrow(compare, "src long, dst long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([p[i] for p in pairs], pa.int64()) for i, k in enumerate(("src", "dst"))})


def pivot_links(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links (src, dst) among ``pairs`` (pivot, member) whose full shingle sets reach the similarity.

    A pivot's members are dealt to parts of about ``_TOGETHER``; each part gets one copy of the
    pivot's text and streams its members past it. ``texts`` has (doc_id, text), one row per id.
    """
    counted = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / _TOGETHER).cast("int").alias("parts"))
    none = F.lit(None).cast("long").alias("label")
    heads = counted.select(F.col("pivot").alias("one"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                           F.lit(0).alias("role"), F.col("pivot").alias("doc_id"), none)
    dealt = pairs.join(counted, "pivot").select(
        F.col("pivot").alias("one"), F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"),
        F.col("member").alias("doc_id"), none)

    def compare(batches):
        head = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            one, role, doc = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i, own in enumerate(shingles.sets(batch.column(5), words)):
                if role[i] == 0:
                    head = own
                    continue
                small, large = sorted((len(head), len(own)))
                if 100 * small >= similarity * large:
                    common = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * common >= similarity * (small + large - common):
                        found.append((one[i], doc[i]))
            yield _links(found)

    return _streamed(heads.unionByName(dealt), texts, compare)


class _Index:
    """Shingle index of a block of documents: common shingles of one more document with all of them at once."""

    def __init__(self, docs: list[tuple[int, int]], sets: list[np.ndarray]):
        self.docs, self.sizes = docs, np.array([len(s) for s in sets])
        self.shingles = np.concatenate(sets)
        order = np.argsort(self.shingles, kind="stable")
        self.shingles, self.owner = self.shingles[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.done = [set() for _ in docs]

    def similar(self, own: np.ndarray, similarity: int) -> np.ndarray:
        low, high = np.searchsorted(self.shingles, own, "left"), np.searchsorted(self.shingles, own, "right")
        count = high - low
        starts = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        hits = self.owner[np.arange(count.sum()) + starts]
        common = np.bincount(hits, minlength=len(self.docs))
        return np.flatnonzero((common > 0) & (100 * common >= similarity * (self.sizes + len(own) - common)))


def group_links(members: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links (src, dst) in groups (pivot, member, label, alone) between members that are ``alone`` and all others.

    ``label`` names a document that the member is known to link with; for members of one label a
    single link is enough. Members that are alone are cut into blocks of about ``_BLOCK``, and the
    members that pass a block into stripes of about ``_STRIPE``, each with a copy of the index: no
    task sees a whole group.
    """
    counted = (members.groupBy("pivot").agg(F.ceil(F.count_if("alone") / _BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"),
                                            F.ceil(F.count("*") / _STRIPE).cast("int").alias("stripes"))
               .where("blocks > 0 AND n > 1").drop("n"))
    sized = members.join(counted, "pivot").select(F.col("pivot").alias("one"), F.col("member").alias("doc_id"), "label", "alone", "blocks", "stripes",
                                                  F.xxhash64("member").alias("hash"))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    place = (F.col("block") * F.col("stripes") + F.col("stripe")).cast("int").alias("part")
    indexed = (sized.where("alone").withColumn("block", F.pmod("hash", "blocks")).withColumn("stripe", every("stripes"))
               .select("one", place, F.lit(0).alias("role"), "doc_id", "label"))
    passing = (sized.withColumn("stripe", F.pmod(F.shiftright("hash", 20), F.col("stripes"))).withColumn("block", every("blocks"))
               .select("one", place, F.when(F.col("alone"), 2).otherwise(1).alias("role"), "doc_id", "label"))

    def compare(batches):
        index, docs, sets, place = None, [], [], None
        for batch in batches:
            found = []
            one, part, role, doc, label = (c.to_pylist() for c in batch.columns[:5])
            for i, own in enumerate(shingles.sets(batch.column(5), words)):
                if (one[i], part[i]) != place:
                    index, docs, sets, place = None, [], [], (one[i], part[i])
                if role[i] == 0:
                    docs.append((doc[i], label[i]))
                    sets.append(own)
                    continue
                if not docs:
                    continue
                index = index or _Index(docs, sets)
                for k in index.similar(own, similarity):
                    other, named = index.docs[k]
                    # of two that are alone the pair is looked at once; labels that agree are connected
                    if other != doc[i] and (role[i] == 1 or other < doc[i]) and named != label[i] and label[i] not in index.done[k]:
                        index.done[k].add(label[i])
                        found.append((other, doc[i]))
            yield _links(found)

    return _streamed(indexed.unionByName(passing), texts, compare)


def linked(classes: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links (src, dst) that connect all class representatives whose sets are similar.

    ``classes`` has (doc_id, bands), one row per distinct set.
    """
    exploded = classes.select("doc_id", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last")
    pairs = stored(exploded.join(shared, "bucket").where("doc_id <> pivot").select("pivot", F.col("doc_id").alias("member")).distinct(), "pairs")
    involved = pairs.select(F.explode(F.array("pivot", "member")).alias("doc_id")).distinct().hint("shuffle_hash")
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(involved, "doc_id", "left_semi")
                   .dropDuplicates(["doc_id"]), "texts")
    first = stored(pivot_links(pairs, texts, words, similarity), "links")
    labels = first.groupBy(F.col("dst").alias("member")).agg(F.min("src").alias("label"))
    direct = first.select(F.col("src").alias("pivot"), F.col("dst").alias("member"), F.lit(False).alias("alone"))
    members = pairs.join(direct, ["pivot", "member"], "left").join(labels, "member", "left").select(
        "pivot", "member", F.coalesce("label", "member").alias("label"), F.coalesce("alone", F.lit(True)).alias("alone"))
    second = stored(group_links(stored(members, "members"), texts, words, similarity), "links")
    return first.unionByName(second)


def groups(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; more columns are left out).

    ``component_id`` is the smallest id reachable over links of documents whose shingle sets have
    100 * intersection >= similarity * union; ``kept`` marks that document. Documents without
    words (null, empty, white space) link with nothing and are kept. Rows of one id are one
    document and share a component; if their texts differ, links are sought for one of them. A row without an id has no
    component and is kept. An empty table gives an empty one.

    Banding finds a pair of similarity s with probability 1 - (1 - s**5)**32: at 0.8 all but three
    in a million, at 0.85 all but seven in a billion. Every link is confirmed on full sets of 64-bit shingle hashes.
    """
    found = stored(profiles(docs, words), "profiles")
    sets = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"))
    sets = stored(sets, "classes")
    chosen = found.join(sets.withColumnRenamed("class_id", "doc_id"), ["d1", "d2", "doc_id"]).dropDuplicates(["doc_id"])
    links = linked(chosen.select("doc_id", "bands"), docs, words, similarity)
    named = sets.join(connected_components(links).withColumnRenamed("node", "class_id"), "class_id", "left")
    named = named.select("d1", "d2", F.coalesce("component", "class_id").alias("component"))
    joined = found.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

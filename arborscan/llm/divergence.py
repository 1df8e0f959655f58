"""Audit of how sources differ in their words: exact counts by sorting pointers to word starts, and divergences of sources.

A term's occurrences are pointers into the Arrow buffer of some texts, a shard. The pointers are sorted by
the bytes they point at, eight at a time: a slice of eight bytes is one number, pointers of equal
slices are sorted by the next slice, and so on until every equal run is one term. Texts lie in the
buffer by language and source and the sort is stable, so the documents and sources of a term are
runs inside its run. Spark adds the shards up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborscan.llm import buffers
from arborscan.llm.common import stored

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
_BLOCK, _TERMS = 256, 8192  # sources whose divergences from all others a task sums, and terms it sums over

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True

_COUNTS = "lang string, source string, term string, n long, docs long"


def pointer_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): the pointers in the order of their terms, equal terms as they came, and the number of each one's run.

    A multikey quicksort over slices of eight bytes: only pointers whose terms go on and agree so
    far are sorted by their next slice. Terms hold no zero byte, so a slice that is filled up with
    zeros tells a term's end.
    """
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), ">u8", wide, 0, (1,))

    def slice_at(pointers: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(lengths[pointers] - 8 * depth, 0, 8)
        key = words[np.minimum(starts[pointers] + 8 * depth, len(data))].astype(np.uint64)
        unused = (8 * (8 - left)).astype(np.uint64)
        return np.where(left == 0, np.uint64(0), key >> np.minimum(unused, np.uint64(63)) << np.minimum(unused, np.uint64(63)))

    order = np.arange(len(starts))
    first = slice_at(order, 0)
    order = np.argsort(first, kind="stable")
    first = first[order]
    changed = np.ones(len(order), bool)
    changed[1:] = first[1:] != first[:-1]
    depth = 1
    at = np.flatnonzero(lengths[order] >= 8)  # places whose terms fill all slices so far
    while len(at):
        run = np.cumsum(changed)[at]
        key = slice_at(order[at], depth)
        by = np.lexsort((key, run))
        order[at] = order[at][by]
        run, key = run[by], key[by]
        new = np.ones(len(at), bool)
        new[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        changed[at] |= new
        depth += 1
        at = at[lengths[order[at]] >= 8 * depth]
    return order, np.cumsum(changed) - 1


def _shard(lang: list, source: list, column: pa.Array) -> Iterator[pa.RecordBatch]:
    """Counts of a shard: one row per language, source and term."""
    groups = sorted(set(zip(lang, source)))
    code = {g: i for i, g in enumerate(groups)}
    of_row = np.array([code[g] for g in zip(lang, source)], np.int64)
    by_group = np.argsort(of_row, kind="stable")
    of_row = of_row[by_group]
    for low, high, data, bounds in buffers.parts(column.take(pa.array(by_group)), 1 << 23):
        data = buffers.LOWER[data]
        starts, ends = buffers.runs(_TERM[data], bounds)
        if not len(starts):
            continue
        lengths = ends - starts
        order, run = pointer_sort(data, starts, lengths)
        doc = np.searchsorted(bounds, starts, "right")[order] - 1
        group = of_row[low:high][doc]
        new_group = np.ones(len(order), bool)
        new_group[1:] = (run[1:] != run[:-1]) | (group[1:] != group[:-1])
        new_doc = new_group.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        firsts = np.flatnonzero(new_group)
        count = np.diff(np.append(firsts, len(order)))
        docs = np.add.reduceat(new_doc.astype(np.int64), firsts)
        found = pa.array(group[firsts])
        names = [pa.array([g[i] for g in groups], pa.string()).take(found) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*names, buffers.strings(data, starts[order[firsts]], lengths[order[firsts]]),
                                          pa.array(count), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in a source's texts and the documents that hold it."""

    def shards(batches):
        for batch in batches:
            lang, source = (batch.column(i).to_pylist() for i in (0, 1))
            yield from _shard(lang, source, batch.column(2))

    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.mapInArrow(shards, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a term in parts of a thousand million, at least 1: exact integers."""
    wide = "decimal(38,0)"
    mass = F.greatest(total.cast(wide) + F.lit(2) * terms.cast(wide), F.lit(1).cast(wide))
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast(wide) * (n.cast(wide) + F.lit(2)), mass)).cast("long")


def divergence(p, q):
    """Divergence of two shares, rounded down; columns or arrays of integers up to a thousand million and one."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), p + q).cast("long")
    return (p - q) * (p - q) // (p + q)


def _pairs(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value): divergences of every two sources of a language, summed over its kept terms.

    The terms of a language are dealt to parts of about ``_TERMS``; a task takes a part and a block of sources,
    fills in the shares of all sources for some terms at a time and adds the block's divergences from all up.
    """
    listed = totals.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", _share(F.lit(0), F.col("total"), F.col("terms")).alias("p")))).alias("sources"),
        F.greatest(F.ceil(F.max("terms") / _TERMS), F.lit(1)).cast("int").alias("parts"))
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.size("sources") - 1) / _BLOCK).cast("int"))).alias("block")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    heads = listed.select("lang", blocks, "sources", "parts").select("lang", "block", part, F.lit(0).alias("role"), "sources")
    shared = kept.join(totals.select("lang", "source", "total", "terms"), ["lang", "source"]).groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))).alias("sources"))
    terms = shared.join(listed.select("lang", blocks, "parts"), "lang").select(
        "lang", "block", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "sources")
    lined = heads.unionByName(terms).repartition("lang", "block", "part").sortWithinPartitions("lang", "block", "part", "role")

    def add(batches):
        task = None

        def result():
            lang, _, _ = task
            first = np.repeat(np.arange(own.start, own.stop), len(names))
            other = np.tile(np.arange(len(names)), own.stop - own.start)
            keep = first != other
            strings = pa.array(names, pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * int(keep.sum()), pa.string()), strings.take(pa.array(first[keep])), strings.take(pa.array(other[keep])),
                 pa.array(sums.ravel()[keep])], ["lang", "source", "item", "value"])

        for batch in batches:
            lang, block, part_, role = (batch.column(i).to_pylist() for i in range(4))
            lists = batch.column(4)
            bounds = lists.offsets.to_numpy()
            flat = lists.values
            source, share = flat.field(0), flat.field(1).to_numpy(zero_copy_only=False)
            starts = [i for i in range(len(role)) if i == 0 or (lang[i], block[i], part_[i]) != (lang[i - 1], block[i - 1], part_[i - 1])]
            for low, high in zip(starts, [*starts[1:], len(role)]):
                if (lang[low], block[low], part_[low]) != task:
                    if task is not None:
                        yield result()
                    task = (lang[low], block[low], part_[low])
                    names = source.slice(bounds[low], bounds[low + 1] - bounds[low]).to_pylist()
                    place = {name: i for i, name in enumerate(names)}
                    none = share[bounds[low]: bounds[low + 1]]
                    own = slice(block[low] * _BLOCK, min(len(names), (block[low] + 1) * _BLOCK))
                    sums = np.zeros((own.stop - own.start, len(names)), np.int64)
                    low += 1
                together = max(1, (1 << 18) // len(names))
                for at in range(low, high, together):
                    end = min(high, at + together)
                    shares = np.tile(none, (end - at, 1))
                    row = np.repeat(np.arange(end - at), np.diff(bounds[at: end + 1]))
                    column = [place[name] for name in source.slice(bounds[at], bounds[end] - bounds[at]).to_pylist()]
                    shares[row, column] = share[bounds[at]: bounds[end]]
                    for k in range(own.start, own.stop):
                        sums[k - own.start] += divergence(shares[:, k: k + 1], shares).sum(axis=0)
        if task is not None:
            yield result()

    found = lined.mapInArrow(add, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of a language differ, and each one's telling terms.

    ``docs`` has (text, lang, source), null read as ''; more columns are left out, rows that repeat
    are counted as often as they stand. Terms are runs of letters A-Z (lower-cased) and of
    characters beyond ASCII; a language keeps those in at least ``min_docs`` of its documents.
    Shares are smoothed by 2 occurrences per kept term and held in whole thousand-millionths.
    ``part`` 'pair' has every other source of the language with the divergence summed over the
    kept terms (0 without any); 'term' the ``top`` kept terms whose share in the source is above
    that in the language, by divergence. Ranks from 1 by value descending, ties by item ascending.
    A source without terms takes part with smoothed shares; an empty table gives an empty result.
    """
    found = stored(counts(docs), "terms")
    kept_terms = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= min_docs)
    kept = stored(found.drop("docs").join(kept_terms.drop("docs"), ["lang", "term"]), "kept")
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    by_lang = kept.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    totals = stored(totals, "totals")
    pairs = _pairs(kept, totals).withColumn("part", F.lit("pair"))
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("of_lang"), F.col("lang_total"), F.col("terms"))
    shares = kept.join(totals, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = shares.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(best))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked_pairs.select(*columns).unionByName(ranked_terms.select(*columns))

"""Approximate nearest neighbours by cross-polytope hashing with fast Hadamard pseudo-rotations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborscan.llm.common import stored
from arborscan.llm.vectors import FOUND, blocked, matrix, merged, usable

TABLES, PROBES, SEED = 8, 28, 11
ROWS, QUERIES, _TOGETHER = 1 << 15, 1 << 13, 1 << 8  # rows and queries of a block, queries of a block compared together
STEPS, ENOUGH = 4, 10  # ranges of norms in a power of two; candidates for each of the k a query asks for


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row (a power of two long), scaled to keep lengths."""
    rows, n = x.shape
    h = 1
    while h < n:
        pairs = x.reshape(rows, -1, 2, h)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """Hash tables over unit vectors: each rotates by three rounds of random signs and Hadamard transform.

    A vector's bucket is the signed axis nearest to it; a query probes the axes nearest to it.
    Only directions count: the points of one set of tables have about the same length.
    """

    def __init__(self, dims: int, tables: int = TABLES, seed: int = SEED):
        self.dims, self.tables = dims, tables
        self.width = 1 << dims.bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.width))

    def _rotated(self, unit: np.ndarray, table: int) -> np.ndarray:
        for signs in self.signs[table]:
            unit = hadamard(unit * signs)
        return unit

    def _unit(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, : self.dims] = x / np.abs(x).max(axis=1, keepdims=True)
        return out / np.sqrt((out ** 2).sum(axis=1, keepdims=True))

    def points(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) buckets: the axis, plus the width for its negative side."""
        unit = self._unit(x)
        out = np.empty((len(x), self.tables), np.int32)
        for table in range(self.tables):
            turned = self._rotated(unit, table)
            axis = np.abs(turned).argmax(axis=1)
            out[:, table] = axis + self.width * (turned[np.arange(len(x)), axis] < 0)
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """(rows, tables, count) buckets of the axes nearest to each query, nearest first."""
        unit = self._unit(x)
        out = np.empty((len(x), self.tables, count), np.int32)
        for table in range(self.tables):
            turned = self._rotated(unit, table)
            out[:, table] = np.argsort(-np.concatenate([turned, -turned], axis=1), axis=1, kind="stable")[:, :count]
        return out


def search(table: DataFrame, is_query, k: int = 20, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query, its own row excepted.

    ``table`` has (vec_id, embedding; more columns are left out), ``is_query`` is a condition on
    vec_id. Rows are parted by their norms into ranges of a factor of 2 ** (1 / ``STEPS``), and every
    range is searched, so that within one the nearest directions have the largest products. Rows are hashed once;
    each block of rows of a range is a set of hash tables in which a block of queries probes: a row is a candidate if it lies in
    one of the query's probed buckets of any table, none is dropped. A query whose buckets of a range hold fewer
    than ``ENOUGH`` * k rows meets the whole range: where the nearest are a good part of all, they are not near. Candidates are ranked by a matrix product first, and all that rounding
    may put among the k best are scored exactly.
    ``score`` is the inner product of the original vectors, summed component by component in
    double precision, ties to the smaller id. Rows with a null id, null or zero vectors or null or
    non-finite components take no part; shorter vectors are padded with zeros. Rows that repeat an
    id are one candidate. Fewer candidates than k are all returned; an empty table gives none.

    Hard case: independent unit vectors, whose nearest ones are hardly nearer than the rest. There
    the defaults find over 0.9 of the 20 nearest, with half of all rows among the candidates.
    """
    rows = usable(table, nonzero=True)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    hashing = CrossPolytope(dims, tables)
    buckets = min(probes, 2 * hashing.width)

    def hashed(ask: bool):
        def run(batches):
            for batch in batches:
                if len(batch):
                    x = matrix(batch.column(1).to_pandas(), dims)
                    largest = np.abs(x).max(axis=1)
                    log2 = np.log2(largest) + np.log2(((x / largest[:, None]) ** 2).sum(axis=1)) / 2
                    codes = hashing.probes(x, buckets).reshape(len(x), -1) if ask else hashing.points(x)
                    both = np.hstack([x, codes])
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(both.ravel()), both.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.round(log2 * STEPS).astype(np.int32))],
                                                     ["vec_id", "v", "norm_range"])
        return run

    def coded(side: DataFrame, ask: bool) -> DataFrame:
        """(vec_id, v, norm_range): ``v`` is the vector followed by its buckets, or by those to probe."""
        return stored(side.mapInArrow(hashed(ask), "vec_id long, v array<double>, norm_range int"), "codes")

    def probed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return compare(left, right, True)

    def whole(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return compare(left, right, False)

    def compare(left: pd.DataFrame, right: pd.DataFrame, by_bucket: bool) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "norm_range": [], "seen": []})
        left = left.sort_values("row_id", kind="stable")
        ids, asked = left["row_id"].to_numpy(), right["query_id"].to_numpy()
        x, q = matrix(left["x"], dims + tables), matrix(right["q"], dims + tables * buckets)
        code, probe = x[:, dims:].astype(np.int64), q[:, dims:].astype(np.int64).reshape(len(q), tables, buckets)
        x, q = np.ascontiguousarray(x[:, :dims]), np.ascontiguousarray(q[:, :dims])
        distinct, first = np.unique(ids, return_index=True)
        length = np.sqrt((x ** 2).sum(axis=1))
        out = []
        for low in range(0, len(q), _TOGETHER):
            own, mine = q[low: low + _TOGETHER], asked[low: low + _TOGETHER]
            rough = own @ x.T
            may = np.full(rough.shape, not by_bucket)
            for t in range(tables if by_bucket else 0):
                wanted = np.zeros((len(own), 2 * hashing.width), bool)
                np.put_along_axis(wanted, probe[low: low + _TOGETHER, t], True, axis=1)
                may |= wanted[:, code[:, t]]
            may &= mine[:, None] != ids[None, :]
            rough[~may] = -np.inf
            best = np.maximum.reduceat(rough, first, axis=1) if len(distinct) < len(ids) else rough  # rows that repeat an id are one candidate
            keep = min(k, best.shape[1])
            least = np.partition(best, -keep, axis=1)[:, -keep]
            slack = 1e-12 * np.sqrt((own ** 2).sum(axis=1)) * length.max()
            row, column = np.nonzero(may & (rough >= (least - slack)[:, None]))
            score = np.zeros(len(row))
            for d in range(dims):
                score += own[row, d] * x[column, d]
            first_of = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
            seen = np.where(first_of, may.sum(axis=1)[row], 0)  # once per query and block
            out.append(pd.DataFrame({"query_id": mine[row], "vec_id": ids[column], "score": score, "seen": seen}))
        found = pd.concat(out)
        found["seen"] = found.groupby("query_id")["seen"].transform("max")
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
        found.loc[found["query_id"].duplicated(), "seen"] = 0
        return found.groupby("query_id", sort=False).head(k).assign(norm_range=left["norm_range"].iloc[0])

    schema = FOUND.format("double") + ", norm_range int, seen long"
    points, asking = coded(rows, False), coded(rows.where(is_query), True)
    ranges = points.select("norm_range").distinct()  # a few per power of two
    queries = asking.withColumn("norm_range", F.explode(ranges.agg(F.collect_list("norm_range")).scalar()))
    found = stored(blocked(points, queries, ["norm_range"], probed, schema, ROWS, QUERIES), "found")
    seen = found.groupBy("query_id", "norm_range").agg(F.sum("seen").alias("n")).withColumnRenamed("query_id", "vec_id")
    short = queries.join(seen, ["vec_id", "norm_range"], "left").where(F.coalesce("n", F.lit(0)) < ENOUGH * k).drop("n")
    return merged(found.unionByName(blocked(points, short, ["norm_range"], whole, schema, ROWS, QUERIES)), k)

"""Exact top-k inner products with a bit-sliced index.

A block of rows keeps, per attribute and bit, one bitmap over its rows. A query's score is the sum
of the attributes' slices, each as often and shifted as the digits of the query's weight say; all
rows of the block are added at once by carry-save adders over bitmaps. The best rows are found
from the most significant slice of the sum downward.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from arborscan.llm.vectors import FOUND, blocked, matrix, merged, usable

SCALE, LEFT_OUT = 256, 3
ROWS, QUERIES, LARGEST = 1 << 14, 512, 1 << 24


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(shift, sign) of the non-adjacent form: the fewest signed powers of two that add up to ``value``."""
    out, shift = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((shift, sign))
            value -= sign
        value >>= 1
        shift += 1
    return out


class SlicedBlock:
    """Bit slices of a block of integer rows, without the ``left_out`` lowest bits, and the rows themselves."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, left_out: int = LEFT_OUT):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.left_out = left_out
        self.low = values.min(axis=0) >> left_out
        shifted = (self.values >> left_out) - self.low
        self.bits = max(1, int(shifted.max()).bit_length())
        self.words = (len(ids) + 63) // 64
        packed = np.zeros((shifted.shape[1], self.bits, self.words * 8), np.uint8)
        for bit in range(self.bits):
            rows = np.packbits(((shifted >> bit) & 1).astype(np.uint8), axis=0, bitorder="little")
            packed[:, bit, : rows.shape[0]] = rows.T
        self.slices = packed.view(np.uint64)
        full = np.zeros(self.words * 64, np.uint8)
        full[: len(ids)] = 1
        self.all = np.packbits(full, bitorder="little").view(np.uint64)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the weighted sum of the stored parts, up to a constant.

        Digits with a minus sign add the complement of a slice: minus a bit is its complement less one.
        """
        columns: dict[int, list[np.ndarray]] = {}
        for attribute, weight in enumerate(weights.tolist()):
            for shift, sign in signed_digits(weight):
                for bit in range(self.bits):
                    plane = self.slices[attribute, bit]
                    columns.setdefault(shift + bit, []).append(plane if sign > 0 else ~plane)
        out, position = [], 0
        while columns:
            planes = np.array(columns.pop(position, []), np.uint64).reshape(-1, self.words)
            carries = []
            while len(planes) > 1:
                if len(planes) == 2:
                    a, b = planes
                    planes, carry = (a ^ b)[None, :], (a & b)[None, :]
                else:
                    third = len(planes) // 3
                    a, b, c = planes[:third], planes[third: 2 * third], planes[2 * third: 3 * third]
                    half = a ^ b
                    carry = (a & b) | (c & half)
                    planes = np.concatenate([half ^ c, planes[3 * third:]])
                carries.extend(carry)
            out.append(planes[0] if len(planes) else np.zeros(self.words, np.uint64))
            if carries:
                columns.setdefault(position + 1, []).extend(carries)
            position += 1
        return out

    def best(self, weights: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best ids but ``own_id``, each with its best row: highest score first, ties to smaller ids."""
        among = self.all.copy()
        for row in range(*np.searchsorted(self.ids, [own_id, own_id + 1])):
            among[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        total, wanted, slices = self._count(among), k, None
        while True:
            rows = among
            if total > wanted:
                slices = slices or self.sums(weights)
                least = self._kth(slices, among, wanted)
                # the bits left out add at most this much to the difference of two rows
                slack = ((1 << self.left_out) - 1) * int(np.abs(weights).sum())
                rows = self._at_least(slices, among, least - -(-slack >> self.left_out))
            picked = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
            scores = self.values[picked] @ weights
            order = np.argsort(-scores, kind="stable")
            # the first ``wanted`` rows are the best ones; if they repeat ids, more rows are looked at
            sure = order if total <= wanted else order[:wanted]
            first = np.sort(np.unique(self.ids[picked[sure]], return_index=True)[1])[:k]
            if len(first) == k or total <= wanted:
                best = sure[first]
                return self.ids[picked[best]], scores[best]
            wanted *= 2

    @staticmethod
    def _count(bitmap: np.ndarray) -> int:
        return int(np.bitwise_count(bitmap).sum())

    def _kth(self, slices: list[np.ndarray], among: np.ndarray, k: int) -> int:
        """The k-th largest sum: walk down the slices and keep the candidates that can still hold it."""
        sure, even, value = 0, among, 0
        for position in range(len(slices) - 1, -1, -1):
            ones = even & slices[position]
            count = self._count(ones)
            if sure + count >= k:
                even, value = ones, value | (1 << position)
            else:
                sure, even = sure + count, even & ~slices[position]
        return value

    def _at_least(self, slices: list[np.ndarray], among: np.ndarray, bound: int) -> np.ndarray:
        if bound <= 0:
            return among
        above, even = np.zeros_like(among), among
        for position in range(max(len(slices), bound.bit_length()) - 1, -1, -1):
            here = slices[position] if position < len(slices) else np.zeros_like(among)
            if bound >> position & 1:
                even = even & here
            else:
                above, even = above | (even & here), even & ~here
        return above | even


def search(table: DataFrame, is_query, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products with all rows but its own.

    ``table`` has (vec_id, embedding; more columns are left out), ``is_query`` is a condition on
    vec_id. Components become floor(scale * x). Rows with a null id, a null vector or null or
    non-finite components take no part; vectors are padded with zeros to the longest one, and values
    beyond 2**24 raise an error. Rows that repeat an id are one candidate with its best score, and
    never one of their own query. Fewer than k candidates are all returned; an empty table gives none.

    Rows and queries meet in blocks of bounded size; each block pair returns k rows per query.
    """
    rows = usable(table)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            whole, asked = (np.floor(scale * matrix(v, dims)) for v in (left["x"], right["q"]))
            if max(np.abs(whole).max(), np.abs(asked).max()) > LARGEST:
                raise ValueError(f"quantised components must stay below {LARGEST}")
            block = SlicedBlock(left["row_id"].to_numpy(), whole.astype(np.int64))
            for query, weights in zip(right["query_id"], asked.astype(np.int64)):
                ids, scores = block.best(weights, query, k)
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = blocked(rows, rows.where(is_query), [], compare, FOUND.format("long"), ROWS, QUERIES)
    return merged(found, k)

"""Packing documents into fixed-length sequences by linear grouping and best fit.

Lengths are integers up to the sequence length, so the whole packing problem is the number of
items per length: at most ``capacity`` counts, whatever the number of documents. The plan is made
for these counts and names, for each length, which ranks go to which sequences and offsets;
documents are ranked within their length and look their place up.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborscan.llm import tokens
from arborscan.llm.common import ranked, stored

CAPACITY, GROUPS, LARGE = 2048, 160, 3

_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document of (doc_id, text), encoded and closed by ``end_id``.

    Only documents longer than ``capacity`` are cut: all pieces are full but the first, which holds
    the rest. A null text is empty, that is one id long.
    """
    text, end = tokens.definition(tokenizer), struct.pack("<I", end_id)

    def cut(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for doc_id, body in zip(batch.column(0).to_pylist(), tokens.encoded(batch.column(1), text)):
                ids = body + end
                total = len(ids) // 4
                stops = range(total % capacity or capacity, total + 1, capacity)
                start = 0
                for number, stop in enumerate([total] if total <= capacity else stops):
                    for column, value in zip(out, (doc_id, number, start, stop - start, zlib.crc32(ids[4 * start: 4 * stop]))):
                        column.append(value)
                    start = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _ITEM)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """(multiplicity, items per size) of the patterns that pack a few sizes best.

    The linear relaxation is solved by column generation: a knapsack over the current prices finds
    the pattern to bring in. Whole parts are returned; what the fractions leave is packed later.
    """
    size, need = np.array(sizes), np.array(demand, float)
    n = len(size)
    basis = np.diag((capacity // size).astype(float))
    amount = need / (capacity // size)
    for _ in range(40 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        value, taken = np.zeros(capacity + 1), []
        for s, p in zip(size, price):
            best, count = value, np.zeros(capacity + 1, np.int32)
            if p > 1e-12:
                for k in range(1, capacity // s + 1):
                    tried = np.concatenate([np.full(k * s, -1.0), value[:-k * s] + k * p])
                    better = tried > best + 1e-12
                    best, count = np.where(better, tried, best), np.where(better, k, count)
            value = best
            taken.append(count)
        if value[capacity] <= 1 + 1e-7:
            break
        pattern, left = np.zeros(n), capacity
        for i in range(n - 1, -1, -1):
            pattern[i] = taken[i][left]
            left -= int(pattern[i]) * int(size[i])
        step = np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(np.argmin(ratio))
        theta = ratio[leaving]
        if not np.isfinite(theta):
            break
        amount = np.maximum(amount - theta * step, 0)
        amount[leaving] = theta
        basis[:, leaving] = pattern
    return [(int(a + 1e-6), basis[:, i].astype(int)) for i, a in enumerate(amount) if int(a + 1e-6)]


def _grouped(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, cut into groups of equal cardinality."""
    total = sum(c for _, c in counts)
    edges = [total * (g + 1) // groups for g in range(groups)]
    out, seen, g = [[] for _ in range(groups)], 0, 0
    for length, count in counts:
        while count:
            while edges[g] <= seen:
                g += 1
            part = min(count, edges[g] - seen)
            out[g].append((length, part))
            seen, count = seen + part, count - part
    return [x for x in out if x]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Runs (sequences, ((length, items of it per sequence), ...)): equal sequences and what each holds, in order.

    Items above 1 / ``LARGE`` of the capacity are large. They are rounded up within groups of
    equal cardinality, the few rounded sizes are packed by ``configurations``, and the actual
    lengths of each group take the places of its rounded size, longest first. The remaining large
    items and the small ones follow, longest first, each into the fullest sequence that has room.
    """
    runs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    large = sorted(((x, c) for x, c in counts.items() if capacity // LARGE < x < capacity and c), reverse=True)
    rest = {x: c for x, c in counts.items() if c and x <= capacity // LARGE}
    done = [(counts[capacity], ((capacity, 1),))] if counts.get(capacity) else []
    if large:
        members = _grouped(large, groups)
        merged: list[list[tuple[int, int]]] = []  # groups that round to one size are one
        for group in members:
            if merged and merged[-1][0][0] == group[0][0]:
                merged[-1] += group
            else:
                merged.append(list(group))
        members = [group[::-1] for group in merged]  # taken from the end, longest first
        found = configurations([g[-1][0] for g in members], [sum(c for _, c in g) for g in members], capacity)
        for times, pattern in sorted(found, key=lambda x: -x[0]):
            slots = []
            for group, k in zip(members, pattern):
                for _ in range(k):
                    need, taken = times, []
                    while need and group:
                        length, count = group.pop()
                        part = min(need, count)
                        taken.append((length, part))
                        need -= part
                        if part < count:
                            group.append((length, count - part))
                    if need:  # fewer documents than places: the place stays free for smaller ones
                        taken.append((0, need))
                    slots.append(taken)
            while slots and slots[0]:
                part = min(s[-1][1] for s in slots)
                held = defaultdict(int)
                for s in slots:
                    length, count = s.pop()
                    held[length] += length > 0
                    if count > part:
                        s.append((length, count - part))
                inside = tuple((x, k) for x, k in held.items() if k)
                if inside:
                    runs[capacity - sum(x * k for x, k in inside)].append((part, inside))
        for group in members:
            for length, count in group:
                rest[length] = rest.get(length, 0) + count
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            gap = min((g for g in runs if g >= length), default=None)
            if gap is None:
                per = capacity // length
                for bins, k in ((left // per, per), (left % per and 1, left % per)):
                    if bins:
                        runs[capacity - k * length].append((bins, ((length, k),)))
                break
            bins, inside = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
            per = gap // length
            used, k = (min(bins, left // per), per) if left >= per else (1, left)
            if used < bins:
                runs[gap].append((bins - used, inside))
            runs[gap - k * length].append((used, (*inside, (length, k))))
            left -= used * k
    return done + [run for gap in sorted(runs) for run in runs[gap]]


def places(runs: list[tuple[int, tuple[tuple[int, int], ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, items per sequence, offset), ordered by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for bins, inside in runs:
        offset = 0
        for length, k in inside:
            out.append((length, rank[length], sequence, k, offset))
            rank[length] += bins * k
            offset += length * k
        sequence += bins
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``items`` plus (sequence_id, offset): gapless from 0 in each sequence; no item is cut, left out or repeated.

    ``items`` has an integer ``length`` from 1 to ``capacity``; other columns are kept (they may not
    be called sequence_id or offset). Only the counts per length, at most ``capacity`` numbers,
    come to the driver; the plan that goes out has a few rows per length. An empty table gives an
    empty one. Equal rows are packed one by one.
    """
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    table = places(plan(counts, capacity, groups))
    keys = table[:, 0] * (1 << 44) + table[:, 1]
    order = [c for c in items.columns if c != "length"]
    numbered = ranked(items, ["length"], order, "_rank")
    schema = numbered.drop("_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1] if len(length) else table[:0]
            past = rank - row[:, 1]
            columns = batch.columns[:-1] + [pa.array(row[:, 2] + past // row[:, 3]), pa.array(row[:, 4] + past % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack ``docs``: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(stored(pieces(docs, tokenizer, capacity), "pieces"), capacity)

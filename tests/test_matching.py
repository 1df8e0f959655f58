import random

import pytest

from arborscan.operators import matching

PAIR = "truth_id long, pred_id long, iou double"


def walk(pairs, threshold):
    by_truth, used, out = {}, set(), {}
    for t, p, v in pairs:
        by_truth.setdefault(t, []).append((p, v))
    for t in sorted(by_truth):
        free = [(v, -p) for p, v in by_truth[t] if p not in used]
        if free and max(free)[0] >= threshold:
            used.add(-max(free)[1])
            out[t] = -max(free)[1]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_equals_sequential_walk(spark, seed):
    rnd = random.Random(seed)
    pairs = [(t, p, rnd.randint(1, 10) / 10) for t in range(30) for p in range(25) if rnd.random() < 0.25]
    got = {r["truth_id"]: r["pred_id"] for r in matching.greedy_match(spark.createDataFrame(pairs, PAIR), 0.5).collect()}
    assert got == walk(pairs, 0.5)


def test_one_prediction_wanted_by_all(spark):
    pairs = [(t, 1, 0.9) for t in range(20)] + [(t, t + 100, 0.6) for t in range(20)]
    got = {r["truth_id"]: r["pred_id"] for r in matching.greedy_match(spark.createDataFrame(pairs, PAIR), 0.5).collect()}
    assert got == {0: 1, **{t: t + 100 for t in range(1, 20)}}


@pytest.mark.parametrize("together", [20_000, 50])
def test_long_chain_of_truths(spark, together, monkeypatch):
    """Each truth's best prediction is also wanted by the one before: the walk passes along the whole chain."""
    pairs = [(t, t + p, 0.9 if p else 0.6) for t in range(60) for p in (0, 1)] + [(t, 500 + t, 0.5) for t in range(60)]
    pairs += [(0, 0, 0.95)]
    calls = []
    monkeypatch.setattr(matching, "cut_lineage", lambda df, cut=matching.cut_lineage: calls.append(1) or cut(df))
    got = {r["truth_id"]: r["pred_id"] for r in matching.greedy_match(spark.createDataFrame(pairs, PAIR), 0.5, rounds=2, together=together).collect()}
    assert got == walk(pairs, 0.5)
    assert together == 50 or len(calls) < 20


@pytest.mark.parametrize("m,p,t,want", [(0, 0, 0, (1.0, 1.0, 1.0)), (0, 0, 3, (0.0, 0.0, 0.0)), (2, 4, 2, (0.5, 1.0, 2 / 3))])
def test_f1_rules(spark, m, p, t, want):
    row = matching.f1(*[spark.range(n) for n in (m, p, t)]).first()
    assert (row["precision"], row["recall"], pytest.approx(row["f1"])) == (want[0], want[1], want[2])


def test_large_joins_get_more_shuffle_partitions(spark, monkeypatch):
    from arborscan.operators import spatial
    seen, real = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "SHARE", 2)
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or real(df))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    boxes = spark.range(60).selectExpr("id", "0 AS key", "id * 10 AS x0", "0 AS y0", "id * 10 + 5 AS x1", "5 AS y1")
    flags = spatial.knn_mask_flag(boxes, boxes.where("id < 4").withColumnRenamed("id", "mask"), ["key"], "id", "mask", 8.0)
    assert seen == [32] and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert flags.where("flag = 1").count() == 4

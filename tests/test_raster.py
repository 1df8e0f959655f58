import numpy as np
import pytest
from pyspark.sql import functions as F

from arborscan.functions import bands, chips as chip_fn, rings
from arborscan.operators import datasets, histogram, metrics, rasters, regions, scoring, segments, stats

CHIP = "chip_id int, w int, h int, cells array<double>"


def chips(spark, arrays):
    return spark.createDataFrame([(i, a.shape[1], a.shape[0], a.ravel().astype(float).tolist()) for i, a in enumerate(arrays)], CHIP)


def grids(df, column, shape):
    return [np.array(r[column], dtype=float).reshape(shape) for r in df.orderBy("chip_id").collect()]


@pytest.fixture(scope="module")
def random_chips():
    rng = np.random.default_rng(3)
    return [rng.integers(0, 60, (6, 9)) for _ in range(4)]


def fold(a, r, fn):
    out = np.empty(a.shape)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            out[y, x] = fn(a[max(0, y - r):y + r + 1, max(0, x - r):x + r + 1])
    return out


def test_morphology(spark, random_chips):
    df = chips(spark, random_chips)
    w, h = F.col("w"), F.col("h")
    got = grids(df.withColumn("r", chip_fn.erode3_close5(F.col("cells"), w, h)), "r", (6, 9))
    want = [fold(fold(fold(a, 1, np.min), 2, np.max), 2, np.min) for a in random_chips]
    assert all(np.array_equal(g, v) for g, v in zip(got, want))
    bounds = df.select(F.forall(F.zip_with("cells", chip_fn.erode(F.col("cells"), w, h, 3), lambda a, b: b <= a), lambda v: v).alias("ok"))
    assert all(r["ok"] for r in bounds.collect())


def test_scene_morphology_crosses_blocks(spark):
    a = np.random.default_rng(4).integers(0, 90, (37, 23))
    cells = spark.createDataFrame([(1, x, y, float(a[y, x])) for y in range(37) for x in range(23)], "k int, x long, y long, v double")
    out = rasters.scene_morphology(cells, ["k"], chip_fn.close5_dilate3, chip_fn.CLOUD_REACH, 8)
    got = np.full(a.shape, -1.0)
    for r in out.collect():
        got[r["y"], r["x"]] = r["v"]
    assert np.array_equal(got, fold(fold(fold(a, 2, np.max), 2, np.min), 1, np.max))


def test_histogram_match(spark):
    rng = np.random.default_rng(5)
    source, template = rng.integers(0, 40, (7, 7)), rng.integers(20, 90, (5, 8))
    df = spark.createDataFrame([(0, source.ravel().astype(float).tolist(), template.ravel().astype(float).tolist())], "chip_id int, previous array<double>, cells array<double>")
    got = np.array(histogram.match(df, ["chip_id"]).first()["previous"])
    _, inverse, counts = np.unique(source.ravel(), return_inverse=True, return_counts=True)
    values, weights = np.unique(template.ravel(), return_counts=True)
    want = np.interp(np.cumsum(counts) / source.size, np.cumsum(weights) / template.size, values)[inverse]
    assert np.allclose(got, want)


def test_otsu(spark, random_chips):
    got = {r["chip_id"]: r["threshold"] for r in histogram.otsu(histogram.counts(chips(spark, random_chips), ["chip_id"]), ["chip_id"]).collect()}
    for i, a in enumerate(random_chips):
        def between(t):
            low, high = a[a <= t], a[a > t]
            return low.size * high.size * (low.mean() - high.mean()) ** 2 if low.size and high.size else 0.0
        best = max(np.unique(a), key=lambda t: (round(between(t), 6), -t))
        assert got[i] == best


def test_laplacian_and_resample(spark, random_chips):
    df = chips(spark, random_chips)
    sharp = grids(df.withColumn("r", chip_fn.laplacian_sharpen(F.col("cells"), F.col("w"), F.col("h"))), "r", (6, 9))
    for a, g in zip(random_chips, sharp):
        p = np.pad(a, 1, mode="reflect")
        box = sum(p[dy:dy + 6, dx:dx + 9] for dy in range(3) for dx in range(3))
        assert np.array_equal(g, np.clip(10 * a - box, 0, 255))
    up = grids(df.withColumn("r", chip_fn.resample(F.col("cells"), F.col("w"), F.col("h"), 2)), "r", (12, 18))
    assert all(np.array_equal(g, np.kron(a, np.ones((2, 2)))) for a, g in zip(random_chips, up))
    down = grids(df.withColumn("r", chip_fn.resample(F.col("cells"), F.col("w"), F.col("h"), 1, 3)), "r", (2, 3))
    assert all(np.array_equal(g, a[::3, ::3]) for a, g in zip(random_chips, down))


def test_turns_are_rotations(spark):
    a = np.arange(16).reshape(4, 4)
    df = chips(spark, [a]).withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rows = df.select("kind", datasets.turn_and_flip(F.col("cells"), F.col("w"), F.col("h"), F.col("kind")).alias("r")).collect()
    for r in rows:
        g = np.array(r["r"]).reshape(4, 4)
        options = [np.rot90(a, k) for k in range(4)] if r["kind"] < 4 else [np.fliplr(np.rot90(a, k)) for k in range(4)]
        assert any(np.array_equal(g, o) for o in options)
    assert len({tuple(r["r"]) for r in rows}) == 8


def flood_labels(mask):
    labels, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not labels[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                cy, cx = todo.pop()
                if 0 <= cy < mask.shape[0] and 0 <= cx < mask.shape[1] and mask[cy, cx] and not labels[cy, cx]:
                    labels[cy, cx] = n
                    todo += [(cy + dy, cx + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return labels


def test_regions_across_blocks(spark):
    mask = np.random.default_rng(6).random((30, 21)) < 0.4
    cells = spark.createDataFrame([(0, int(x), int(y)) for y, x in zip(*np.nonzero(mask))], "k int, x long, y long")
    labels = flood_labels(mask)
    found = {}
    for r in regions.label_regions(cells, ["k"], 8).collect():
        found.setdefault(r["region"], set()).add(labels[r["y"], r["x"]])
    assert all(len(v) == 1 for v in found.values()) and len(found) == labels.max()


def region(spark, rows):
    cells = [(0, "r", x, y) for y, line in enumerate(rows) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(cells, "k int, region string, x long, y long")


def test_polygonize_holes_and_centres(spark):
    ringed = region(spark, ["#####", "#...#", "#...#", "#####"])
    separate = regions.polygonize(ringed, ["k"]).select("hole", rings.area(F.col("shape")).alias("a")).collect()
    assert sorted((r["hole"], r["a"]) for r in separate) == [(False, 20.0), (True, 6.0)]
    one = regions.polygonize(ringed, ["k"], holes="ring").select(rings.area(F.col("shape")).alias("a"), rings.is_valid(F.col("shape")).alias("ok")).first()
    assert (one["a"], one["ok"]) == (14.0, True)
    centres = regions.polygonize(region(spark, ["####", "####", "####"]), ["k"], (10.0, 0.0, 100.0, 0.0, -10.0, 0.0), boundary="center").first()["shape"][0]
    assert sorted({(p["x"], p["y"]) for p in centres}) == [(105.0, -25.0), (105.0, -5.0), (135.0, -25.0), (135.0, -5.0)] and len(centres) == 5
    # a single cell and a straight run have no contour of three points
    assert regions.polygonize(region(spark, ["###"]), ["k"], boundary="center").count() == 0
    # cells that touch at a corner stay in one outer ring
    diagonal = regions.polygonize(region(spark, ["#.", ".#"]), ["k"]).collect()
    assert len(diagonal) == 1 and not diagonal[0]["hole"]


def spiral(side):
    mask = np.zeros((side, side), bool)
    x, y, dx, dy = 0, 0, 1, 0
    mask[0, 0] = True
    while True:
        for _ in range(2):
            beyond = (x + 2 * dx, y + 2 * dy)
            free = 0 <= x + dx < side and 0 <= y + dy < side and not (0 <= beyond[0] < side and 0 <= beyond[1] < side and mask[beyond[1], beyond[0]])
            if free:
                break
            dx, dy = -dy, dx
        if not free or mask[y + dy, x + dx]:
            return mask
        x, y = x + dx, y + dy
        mask[y, x] = True


def filled(shape, size):
    """Cells whose centre lies inside by even-odd."""
    grid = np.zeros(size, int)
    for ring in shape:
        for p, q in zip(ring, ring[1:]):
            if p["x"] == q["x"]:
                low, high = sorted((int(p["y"]), int(q["y"])))
                grid[low:high, int(p["x"]):] += 1
    return grid % 2 == 1


@pytest.mark.parametrize("block", [1, 5, 256])
def test_outlines_across_blocks(spark, block):
    masks = [np.random.default_rng(11).random((19, 23)) < 0.55, spiral(23), np.ones((12, 31), bool)]
    masks[2][3:9, 4:27:2] = False
    rows = [(k, f"r{labels[y, x]}", int(x), int(y)) for k, labels in enumerate(map(flood_labels, masks)) for y, x in zip(*np.nonzero(labels))]
    df = spark.createDataFrame(rows, "k int, region string, x long, y long")
    expected = {}
    for k, name, x, y in rows:
        expected.setdefault((k, name), set()).add((x, y))
    found = regions.polygonize(df, ["k"], holes="ring", block=block).collect()
    assert {(r["k"], r["region"]): {(int(x), int(y)) for y, x in zip(*np.nonzero(filled(r["shape"], masks[r["k"]].shape)))} for r in found} == expected
    assert len(found) == len(expected) and all(ring[0] == ring[-1] for r in found for ring in r["shape"])
    # every corner turns, and the comb's eleven slits and its last one are holes of their own with parts counted on
    turns = [(p["x"] == q["x"]) != (q["x"] == s["x"]) for r in found for ring in r["shape"] for p, q, s in zip(ring, ring[1:], ring[2:])]
    assert all(turns)
    parts = regions.polygonize(df.where("k = 2"), ["k"], block=block).select("part", "hole").collect()
    assert sorted((r["part"], r["hole"]) for r in parts) == [(n, n > 0) for n in range(13)]


def test_chamfer_distance_and_flood(spark):
    mask = np.zeros((7, 9))
    mask[1:6, 1:8] = 1
    d = grids(segments.distance_to_background(chips(spark, [mask]), "cells"), "distance", (7, 9))[0]
    straight = 0.955
    assert d.max() == 1.0 and d[3, 4] == pytest.approx(1.0) and d[1, 1] == pytest.approx(1 / 3) and segments.chamfer_grid(mask > 0)[3, 4] == pytest.approx(3 * straight)
    image, seeds = np.zeros((12, 12)), np.zeros((12, 12))
    seeds[10, 1], seeds[1, 10] = 1, 1
    df = chips(spark, [image]).withColumn("seeds", F.array(*[F.lit(float(v)) for v in seeds.ravel()]))
    out = grids(segments.flood(df, "cells", "seeds"), "instance", (12, 12))[0]
    assert {1.0, 2.0, 255.0} <= set(np.unique(out)) and out[5, 5] == 255 and not (out == 0).any()


def test_calc_rules(spark):
    cells = spark.createDataFrame([(0, 1.0, 5.0), (1, 255.0, 5.0), (2, 3.0, -9.0)], "i int, A double, B double")
    out = {r["i"]: r["result"] for r in rasters.calc(cells, "A * 100 + B", ["A", "B"], {"A": 255}, {"A": "Byte", "B": "UInt16"}).collect()}
    assert out == {0: 105, 1: 65535, 2: 291}
    byte = {r["i"]: r["result"] for r in rasters.calc(cells, "A * 100 + B", ["A", "B"], out_type="Byte", out_nodata=7, nodata={"B": 5}).collect()}
    assert byte == {0: 7, 1: 7, 2: 255}
    wide = spark.createDataFrame([(1, 0, 2, 1, [1.0, 2.0]), (1, 1, 3, 1, [1.0, 2.0, 3.0])], "s int, band int, w int, h int, cells array<double>")
    with pytest.raises(Exception, match="dimensions differ"):
        rasters.align_bands(wide, ["s"], [0, 1], ["a", "b"]).collect()


def test_mosaic_of_unlike_grids(spark):
    rng = np.random.default_rng(4)
    grids = [rasters.Grid(5, 83, 9, 7, 10, 10), rasters.Grid(-22, 61, 6, 5, 20, 15), rasters.Grid(31, 70, 13, 9, 4, 5)]
    images = [rng.integers(1, 99, (g.height, g.width)) for g in grids]
    images[2][::3, ::2] = 0
    sources = [(spark.createDataFrame([("a", x, y, float(v)) for (y, x), v in np.ndenumerate(i)], "k string, x long, y long, v double"), g) for i, g in zip(images, grids)]
    out, target = rasters.mosaic_grids(sources, ["k"], nodata=0.0, init=-1.0, aligned=True)
    assert target == rasters.Grid(-30, 90, 13, 11, 10, 10)
    expected = np.full((target.height, target.width), -1.0)
    for image, g in zip(images, grids):
        x0, x1 = int((g.left + 30) / 10 + 0.1), int((g.right + 30) / 10 + 0.5)
        y0, y1 = int((90 - g.top) / 10 + 0.1), int((90 - g.bottom) / 10 + 0.5)
        for y in range(y0, min(y1, target.height)):
            for x in range(x0, min(x1, target.width)):
                v = image[int((y - y0 + 0.5) * g.height / (y1 - y0)), int((x - x0 + 0.5) * g.width / (x1 - x0))]
                expected[y, x] = v or expected[y, x]
    got = out.collect()
    assert len(got) == expected.size and {(r["x"], r["y"]): r["v"] for r in got} == {(x, y): v for (y, x), v in np.ndenumerate(expected)}
    assert rasters.mosaic_grids([(sources[0][0].limit(0), grids[0])], ["k"], init=0.0)[0].count() == 0


def test_mosaic_rules(spark):
    ddl = "x int, y int, v double, masked boolean"
    first = spark.createDataFrame([(0, 0, 1.0, False), (1, 0, 2.0, False), (2, 0, 3.0, False)], ddl)
    second = spark.createDataFrame([(0, 0, 9.0, False), (1, 0, 0.0, False), (2, 0, 8.0, True)], ddl)
    extent = spark.range(5).select(F.col("id").cast("int").alias("x"), F.lit(0).alias("y"))
    got = {r["x"]: r["v"] for r in rasters.mosaic([first, second], [], nodata=0.0, init=-1.0, extent=extent).collect()}
    assert got == {0: 9.0, 1: 2.0, 2: 3.0, 3: -1.0, 4: -1.0}


def test_byte_rounding_and_channels(spark):
    row = spark.range(1).select(*[bands.to_byte(F.lit(v)).alias(f"b{i}") for i, v in enumerate((0.5, 1.49, 254.5, 300.0, -3.0))],
                                bands.linear_byte(F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("flat"),
                                bands.difference_byte(F.lit(0.0), F.lit(0.0)).alias("zero")).first()
    assert tuple(row) == (1, 1, 255, 255, 0, 0, 127)
    assert bands.channel_count(["rgb", "b8", "ndmi"]) == 5 and bands.channel_bands(["b8", "rgb"], 2) == [3, 0, 1, 2, 12, 9, 10, 11]
    with pytest.raises(ValueError):
        bands.channel_count(["swir"])


def test_metric_edges(spark):
    empty = F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(metrics.dice(empty, empty).alias("a"), metrics.dice(empty, empty, None).alias("b"), metrics.iou(empty, empty).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (1.0, float("inf"), 1.0)
    cells = spark.createDataFrame([(1, 0, 0), (2, 0, 5), (3, 4, 0), (4, 1, 1)] + [(5, 1, 1)] * 9 + [(5, 1, 2)], "c int, label int, instance int")
    got = {r["c"]: r["dice"] for r in metrics.dice_at_thresholds(cells, ["c"]).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and got[3] == 0.0 and got[4] == 1.0 and 0 < got[5] < 1


def test_exact_quantiles_and_pages(spark):
    rng = np.random.default_rng(8)
    data = [(int(g), float(v)) for g in range(3) for v in np.concatenate([rng.normal(0, 50, 200), np.full(300, 7.25)])]
    df = spark.createDataFrame(data, "g int, v double")
    for r in stats.quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0], ["g"]).collect():
        assert np.allclose(r["q"], np.quantile([v for g, v in data if g == r["g"]], [0.0, 0.1, 0.5, 0.99, 1.0]))
    rows = spark.createDataFrame([(i, float(i % 4)) for i in range(23)], "id int, v double")
    got = sorted((r["page"], r["v"], r["id"]) for r in stats.paged(rows, "v", "id", 5).collect())
    want = sorted((i, float(i % 4)) for i in range(23))
    want.sort(key=lambda r: (r[1], r[0]))
    assert got == sorted((n // 5, v, i) for n, (i, v) in enumerate(want))


def test_stratified_shares_are_exact_and_stable(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3900, 0).otherwise(1).alias("label"))
    first = datasets.stratified_split(df, "id", "label", 0.2, 0.25)
    counts = {(r["label"], r["split"]): r["count"] for r in first.groupBy("label", "split").count().collect()}
    assert counts == {(0, "test"): 780, (0, "val"): 780, (0, "train"): 2340, (1, "test"): 20, (1, "val"): 20, (1, "train"): 60}
    again = datasets.stratified_split(df.repartition(7), "id", "label", 0.2, 0.25)
    assert first.exceptAll(again).isEmpty()


def test_markup_without_old_dates_uses_the_first(spark):
    import datetime as dt
    markup = spark.createDataFrame([(1, dt.date(2020, 5, 5)), (2, dt.date(2020, 5, 6)), (3, dt.date(2020, 5, 7))], "pk int, img_date date")
    assert sorted(r["pk"] for r in datasets.markup_until(markup, "2019-01-01", "pk").collect()) == [1, 2]
    assert sorted(r["pk"] for r in datasets.markup_until(markup, "2020-05-06", "pk").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        datasets.markup_in_state(markup, "closed")


def test_model_is_loaded_in_the_task(spark):
    def load():
        def model(batch):
            return [chip.sum(axis=0) for chip in batch]
        return model
    df = spark.createDataFrame([(1, 2, 1, [[1.0, 2.0], [3.0, 4.0]])], "chip_id int, w int, h int, stack array<array<double>>")
    assert scoring.score_chips(df, load).first()["cells"] == [4.0, 6.0]


def test_detection_end_to_end(spark):
    """A square that loses brightness between two scenes comes out as one flagged polygon."""
    from arborscan.plans import detection
    side, rows = 16, []
    rng = np.random.default_rng(1)
    base = rng.integers(150, 200, (2 * side, 2 * side))
    for scene in (0, 1):
        for band in range(9):
            image = base + band
            if scene == 1:
                image = image.copy()
                image[6:26, 6:26] = image[6:26, 6:26] // 3
            for cy in (0, 1):
                for cx in (0, 1):
                    part = image[cy * side:(cy + 1) * side, cx * side:(cx + 1) * side]
                    rows.append((1, scene, cx, cy, band, side, side, part.ravel().astype(float).tolist()))
    chips_df = spark.createDataFrame(rows, "tile_id int, scene int, chip_x int, chip_y int, band int, w int, h int, cells array<double>")
    masks = "tile_id int, mask_id int, x0 double, y0 double, x1 double, y1 double"
    forest = spark.createDataFrame([(1, 1, 0.0, -1000.0, 1000.0, 0.0)], masks)
    clouds = spark.createDataFrame([(1, 1, 5000.0, 5000.0, 5100.0, 5100.0)], masks)

    def dark():
        return lambda batch: [np.where(c[9:18].mean(axis=0) < 100, 1.0, 0.0) for c in batch]

    out = detection.detect(chips_df, ["tile_id"], forest, clouds, dark).collect()
    assert len(out) == 1
    # erosion takes one cell on each side; the closing does not change a square
    assert (out[0]["forest"], out[0]["clouds"]) == (1, 0) and out[0]["area"] > 0


def test_positions_of_skewed_values(spark):
    """One outlier, and one value for most rows: buckets stay even and positions exact."""
    import random

    from arborscan.operators import stats
    draw = random.Random(4)
    rows = [(i, draw.random()) for i in range(3000)] + [(3000, 1e12)] + [(4000 + i, 0.5) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = sorted((r["start"], r["v"], r["n"]) for r in stats.positioned(df, "v").collect())
    at, want = 0, []
    for v in sorted({v for _, v in rows}):
        n = sum(1 for _, x in rows if x == v) if v == 0.5 else 1
        want.append((at, v, n))
        at += n
    assert got == want
    cuts = df.select("v").distinct().agg(stats._borders("v").alias("c"))
    sizes = [r["n"] for r in df.select("v").distinct().withColumn("c", cuts.scalar()).withColumn("b", stats._bucket(F.col("v"), F.col("c"))).groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 3 * 3001 / len(sizes) + 20
    pages = {r["id"]: r["page"] for r in stats.paged(df, "v", "id", 7).collect()}
    assert pages == {i: n // 7 for n, (v, i) in enumerate(sorted((v, i) for i, v in rows))}


def test_instances_beyond_254_are_graded(spark):
    from arborscan.operators import metrics

    cells = spark.createDataFrame([(1, label, label) for label in (1, 254, 256, 300) for _ in range(9)] + [(1, 255, 0), (1, 0, 0)], "chip_id long, label int, instance int")
    assert sorted(r.label for r in metrics.iou_matrix(cells, ["chip_id"]).collect()) == [1, 254, 256, 300]
    assert metrics.dice_at_thresholds(cells, ["chip_id"]).first().dice == 1

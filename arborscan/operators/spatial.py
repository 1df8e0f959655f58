"""Spatial joins on grid cells.

Every join turns geometry into equi-keys: a row goes to the cells its box covers, so the
planner sees an ordinary hash or sort-merge join instead of a nested loop. A box has a size
class, and a pair meets in cells of the coarser of its two classes. It meets there in one of
two roles: the left box is of that class and the right one of it or finer, or the right box is
of that class and the left one finer. So every candidate pair holds a box native to the class:
a huge polygon costs one more cell for each box on the other side, and small boxes never meet
at a coarse class. Copies are made only for classes that occur on the other side.

The plan is the same for every size. A cell that is hot on either side is a skewed key of an
equi-join, which adaptive execution splits (``spark.sql.adaptive.skewJoin``); nothing runs
while a join is being described.

Boxes are columns ``x0, y0, x1, y1``. Joins return the pair as structs ``a`` and ``b``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborscan.session import cut_lineage, wider_shuffles

SHARE = 200_000  # rows of a large join per shuffle partition at most, so that a task's sorts do not grow with the tables


def _extent(pad: Column | float) -> Column:
    return F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * pad


def _size_class(cell: float, pad: Column | float) -> Column:
    """0 for boxes up to one cell, +1 for every doubling."""
    ratio = F.greatest(_extent(pad) / F.lit(float(cell)), F.lit(1.0))
    return F.ceil(F.log2(ratio)).cast("int")


def _classes(df: DataFrame, cell: float, pad: Column | float) -> Column:
    """The size classes of a table as an array (a scalar subquery; some thirty at most)."""
    return df.agg(F.sort_array(F.collect_set(_size_class(cell, pad))).alias("classes")).scalar()


def _spread(df: DataFrame, keys: list[str], name: str, cell: float, pad: Column | float, classes: Column, roles) -> DataFrame:
    """One row per (class, role) of ``roles(own, classes)`` and cell that a box covers, the row itself in struct ``name``."""
    row = df.select(*keys, classes.alias("_classes"), F.struct(*df.columns).alias(name), _size_class(cell, pad).alias("_own"),
                    (F.col("x0") - pad).alias("_x0"), (F.col("y0") - pad).alias("_y0"),
                    (F.col("x1") + pad).alias("_x1"), (F.col("y1") + pad).alias("_y1"))
    row = row.withColumn("_r", F.explode(roles(F.col("_own"), F.col("_classes"))))
    classes = row.withColumns({"_class": F.col("_r.class"), "_role": F.col("_r.role")}).drop("_r", "_classes")
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_class"))
    span = [F.floor(F.col(c) / size) for c in ("_x0", "_x1", "_y0", "_y1")]
    return (classes.withColumn("_cx", F.explode(F.sequence(span[0], span[1])))
            .withColumn("_cy", F.explode(F.sequence(span[2], span[3]))))


def _role(class_: Column, role: int) -> Column:
    return F.struct(class_.alias("class"), F.lit(role).alias("role"))


def box_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float, pad: Column | float = 0.0,
             on: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """All pairs whose boxes meet (boundary contact counts), the left box widened by ``pad``.

    ``pad`` may be a column of the left side. ``on(a, b)`` adds an exact predicate. Each
    pair comes out once, from the cell that holds the lower corner of the common box.
    """
    pad = pad if isinstance(pad, Column) else F.lit(float(pad))
    none = F.lit(0.0)

    def left_roles(own: Column, classes: Column) -> Column:
        return F.concat(F.array(_role(own, 0)), F.transform(F.filter(classes, lambda c: c > own), lambda c: _role(c, 1)))

    def right_roles(own: Column, classes: Column) -> Column:
        return F.concat(F.transform(F.filter(classes, lambda c: c >= own), lambda c: _role(c, 0)), F.array(_role(own, 1)))

    a = _spread(left, keys, "a", cell, pad, _classes(right, cell, none), left_roles)
    where = [*keys, "_class", "_role", "_cx", "_cy"]
    b = _spread(right, keys, "b", cell, none, _classes(left, cell, pad), right_roles).select(
        *where, "b", *[F.col(c).alias(f"{c}b") for c in ("_x0", "_y0", "_x1", "_y1")])

    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_class"))
    low_x, low_y = F.greatest("_x0", "_x0b"), F.greatest("_y0", "_y0b")
    meets = (low_x <= F.least("_x1", "_x1b")) & (low_y <= F.least("_y1", "_y1b"))
    once = (F.floor(low_x / size) == F.col("_cx")) & (F.floor(low_y / size) == F.col("_cy"))
    pairs = a.join(b, where).where(meets & once).select("a", "b")
    return pairs.where(on(F.col("a"), F.col("b"))) if on is not None else pairs


def box_overlap(a: Column, b: Column, grow: int = 0) -> Column:
    """Common area of two boxes, the first grown by ``grow`` on every side."""
    dx = F.least(a["x1"] + grow, b["x1"]) - F.greatest(a["x0"] - grow, b["x0"])
    dy = F.least(a["y1"] + grow, b["y1"]) - F.greatest(a["y0"] - grow, b["y0"])
    return F.greatest(dx, F.lit(0)) * F.greatest(dy, F.lit(0))


def box_area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def box_iou(a: Column, b: Column) -> Column:
    common = box_overlap(a, b)
    return common / (box_area(a) + box_area(b) - common)


def box_gap_sq(a: Column, b: Column) -> Column:
    """Squared distance of two boxes."""
    dx = F.greatest(F.lit(0), a["x0"] - b["x1"], b["x0"] - a["x1"])
    dy = F.greatest(F.lit(0), a["y0"] - b["y1"], b["y0"] - a["y1"])
    return dx * dx + dy * dy


def within_distance(left: DataFrame, right: DataFrame, keys: list[str], metres: float, cell: float | None = None,
                    gap_sq: Callable[[Column, Column], Column] = box_gap_sq) -> DataFrame:
    """Pairs at most ``metres`` apart (inclusive) in local metric coordinates."""
    return box_join(left, right, keys, cell or max(metres, 1.0), pad=metres,
                    on=lambda a, b: gap_sq(a, b) <= metres * metres)


def intersecting(left: DataFrame, right: DataFrame, keys: list[str], cell: float,
                 exact: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs with a common point; boxes decide alone unless ``exact`` is given."""
    return box_join(left, right, keys, cell, on=exact)


def adjacent(polygons: DataFrame, keys: list[str], id: str, cell: float, min_area: float = 20.0,
             grow: int = 1) -> DataFrame:
    """Pairs (id_a < id_b) that meet and share more than ``min_area`` once the first is grown."""
    pairs = box_join(polygons, polygons, keys, cell, on=lambda a, b: (
        (a[id] < b[id]) & (box_overlap(a, b, grow) > min_area)))
    return pairs.select(F.col(f"a.{id}").alias("src"), F.col(f"b.{id}").alias("dst"))


def _centre(df: DataFrame) -> DataFrame:
    """The box shrunk to its doubled centre, kept in integers: x0 = x1 = 2 * centre."""
    cx, cy = F.col("x0") + F.col("x1"), F.col("y0") + F.col("y1")
    return df.withColumns({"x0": cx, "y0": cy, "x1": cx, "y1": cy})


def knn_mask_flag(polygons: DataFrame, masks: DataFrame, keys: list[str], id: str, mask_id: str, cell: float,
                  k: int | None = 10, exact: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Flag per polygon: 1 when one of its ``k`` masks with nearest centroid intersects it.

    That is the case exactly when fewer than ``k`` masks lie nearer than the nearest
    *intersecting* one, so only that one distance is examined per polygon, and the search
    radius is bounded by the size of two polygons. ``k=None`` drops the limit. Ties in
    distance go to the smaller mask id.
    """
    def centre_gap_sq(a: Column, b: Column) -> Column:
        dx, dy = a["x0"] + a["x1"] - b["x0"] - b["x1"], a["y0"] + a["y1"] - b["y0"] - b["y1"]
        return dx * dx + dy * dy

    spark = polygons.sparkSession
    rows = polygons.count() + masks.count()
    hits = intersecting(polygons, masks, keys, cell, exact)
    nearest = (hits.select(*[F.col(f"a.{c}").alias(c) for c in [*keys, id, "x0", "y0", "x1", "y1"]],
                           F.struct(centre_gap_sq(F.col("a"), F.col("b")).alias("d"), F.col(f"b.{mask_id}").alias("m")).alias("_hit"))
               .groupBy(*keys, id, "x0", "y0", "x1", "y1").agg(F.min("_hit").alias("_hit")))
    if k is None:
        flagged = nearest.select(id, F.lit(1).alias("flag"))
    else:
        with wider_shuffles(spark, math.ceil(rows / SHARE)):
            nearest = cut_lineage(nearest)
        probe = _centre(nearest)
        nearer = box_join(probe, _centre(masks.select(*keys, mask_id, "x0", "y0", "x1", "y1")), keys, cell * 2,
                          pad=F.sqrt(F.col("_hit.d").cast("double")),
                          on=lambda a, b: (F.struct(centre_gap_sq(a, b) / 4, b[mask_id])
                                           < F.struct(a["_hit"]["d"].cast("double"), a["_hit"]["m"])))
        counts = nearer.groupBy(F.col(f"a.{id}").alias(id)).agg(F.count("*").alias("_nearer"))
        flagged = (nearest.select(id).join(counts, id, "left")
                   .select(id, (F.coalesce(F.col("_nearer"), F.lit(0)) < k).cast("int").alias("flag")))
    return polygons.join(flagged, id, "left").withColumn("flag", F.coalesce(F.col("flag"), F.lit(0)))


def k_nearest(points: DataFrame, targets: DataFrame, keys: list[str], id: str, target_id: str, k: int,
              cell: float, together: int = 512) -> DataFrame:
    """The ``k`` targets with nearest centre per point, rank 1..k (ties by target id).

    Targets are counted per cell of a quadtree over all centres. A home is a cell of fewer than k targets
    in one that holds k, or a finest cell: for its points the k nearest are no farther than that
    parent's diagonal, so the targets this close to the home go there as arrays of about ``together``, and
    each point sorts its home's array in place. Copies are made per home, not per point, and the k nearest of a point
    need no further shuffle unless its home has several arrays or its id several rows.
    """
    p, t = (_centre(side.select(*keys, name, "x0", "y0", "x1", "y1")).select(*keys, name, "x0", "y0") for side, name in ((points, id), (targets, target_id)))
    cell = 2.0 * cell
    ends = p.select("x0", "y0").unionByName(t.select("x0", "y0")).agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x0", "y0")]).first()
    low = {c: ends[f"min_{c}"] for c in ("x0", "y0")}
    if None in low.values():
        low = {c: 0 for c in low}
    wide = max((ends[f"max_{c}"] or 0) - low[c] for c in low)
    top = max(0, math.ceil(math.log2(wide / cell + 1)))
    size = lambda c: F.lit(cell) * F.pow(F.lit(2.0), c)

    def at(df: DataFrame, classes: Column) -> DataFrame:
        spread = df.withColumn("_class", F.explode(classes))
        return spread.withColumns({n: F.floor((F.col(c) - F.lit(low[c])) / size(F.col("_class"))) for n, c in (("_cx", "x0"), ("_cy", "y0"))})

    place = [*keys, "_class", "_cx", "_cy"]
    finest = lambda df: at(df, F.array(F.lit(0))).groupBy(*place).agg(F.count("*").cast("long").alias("_n"))
    spots = finest(p).withColumns({"_m": F.lit(1), "_n": F.lit(0).cast("long")}).unionByName(finest(t).withColumn("_m", F.lit(0)))
    up = lambda c: F.expr(f"shiftright({c}, _class)")
    counts = cut_lineage(spots.withColumn("_class", F.explode(F.sequence(F.lit(0), F.lit(top + 1)))).withColumns({"_cx": up("_cx"), "_cy": up("_cy")})
                         .groupBy(*place).agg(F.sum("_n").alias("_n"), F.max("_m").alias("_m")))
    rich = counts.where((F.col("_n") >= k) & (F.col("_class") <= top)).select(*place)
    # cells with points and fewer than k targets in a cell that holds k
    some = counts.where("_m = 1").select(*keys, F.col("_class").alias("_c"), F.col("_cx").alias("_x"), F.col("_cy").alias("_y"), "_n")
    poor = some.where(F.col("_n") < k).withColumns({"_class": F.col("_c") + 1, "_cx": F.shiftright("_x", 1), "_cy": F.shiftright("_y", 1)})
    homes = poor.join(rich, place, "left_semi").withColumn("_of", F.col("_c") + 1)
    whole = some.where((F.col("_c") == 0) & (F.col("_n") >= k) | (F.col("_c") == top) & (F.col("_n") < k)).withColumn("_of", F.col("_c"))
    named_home = [*keys, F.col("_c").alias("_class"), F.col("_x").alias("_cx"), F.col("_y").alias("_cy"), "_of"]
    homes = cut_lineage(homes.select(*named_home).unionByName(whole.select(*named_home)))
    counts = counts.where("_n > 0").drop("_m")

    # the box around a home that its targets lie in, in cells one class above its parent
    reach = size(F.col("_of")) * math.sqrt(2.0) * (1 + 1e-9)
    edge = {f"_{n}{i}": F.lit(low[c]) + (F.col(f"_c{n}") + i) * size(F.col("_class")) for n, c in (("x", "x0"), ("y", "y0")) for i in (0, 1)}
    boxed = homes.withColumns({**edge, "_reach": reach, "_up": F.col("_of") + 1})
    around = lambda n, c: F.explode(F.sequence(F.floor((F.col(f"_{n}0") - F.col("_reach") - F.lit(low[c])) / size(F.col("_up"))),
                                               F.floor((F.col(f"_{n}1") + F.col("_reach") - F.lit(low[c])) / size(F.col("_up")))))
    boxed = boxed.withColumn("_bx", around("x", "x0")).withColumn("_by", around("y", "y0"))
    coarse = [*keys, "_up", "_bx", "_by"]
    named = lambda df: df.withColumnsRenamed({"_class": "_up", "_cx": "_bx", "_cy": "_by"})
    parts = F.ceil(F.sum("_n").over(Window.partitionBy(*place)) / together)
    held = cut_lineage(boxed.join(named(counts), coarse).withColumn("_parts", parts).drop("_n"))
    classes = sorted(r[0] for r in held.select("_up").distinct().collect())
    met = held.join(named(at(t, _numbers(classes))), coarse)
    beside = lambda n, c: F.greatest(F.col(f"_{n}0") - F.col(c), F.col(c) - F.col(f"_{n}1"), F.lit(0.0))
    met = met.where(beside("x", "x0") * beside("x", "x0") + beside("y", "y0") * beside("y", "y0") <= F.col("_reach") * F.col("_reach"))
    lists = (met.select(*place, "_parts", F.pmod(F.xxhash64(target_id), "_parts").alias("_part"), target_id, "x0", "y0")
             .groupBy(*place, "_parts", "_part").agg(F.collect_list(F.struct(target_id, "x0", "y0")).alias("_t")))

    own = sorted(r[0] for r in homes.select("_class").distinct().collect())
    single = p.withColumn("_same", F.count("*").over(Window.partitionBy(id)))
    there = at(single, _numbers(own)).withColumnsRenamed({"x0": "_px", "y0": "_py"}).join(lists, place)
    gap = lambda c: (c["x0"] - F.col("_px")) * (c["x0"] - F.col("_px")) + (c["y0"] - F.col("_py")) * (c["y0"] - F.col("_py"))
    nearest = F.slice(F.sort_array(F.transform("_t", lambda c: F.struct(gap(c).alias("dist4"), c[target_id].alias("m")))), 1, k)
    alone = (F.col("_same") == 1) & (F.col("_parts") == 1)
    ranked = there.where(alone).select(id, F.posexplode(nearest).alias("_r", "_c")).select(
        id, F.col("_c.m").alias(target_id), "_c.dist4", (F.col("_r") + 1).alias("rank"))
    order = Window.partitionBy(id).orderBy("dist4", target_id)
    merged = there.where(~alone).select(id, F.explode(nearest).alias("_c")).select(id, F.col("_c.m").alias(target_id), "_c.dist4")
    return ranked.unionByName(merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")

"""Scene catalogue: tiles, listings, quality limits, state flags, upserts and pairs.

A tile holds at most one scene per calendar day once ``scene_per_day`` or
``upsert_scenes`` has run, so the windows over ``tile_id`` below see a group bounded by
the calendar, however many raw listings one tile contributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborscan.functions import names

MAX_NODATA = 5.0
MAX_CLOUD = 50.0
START_DATE = "2017-01-01"

# File suffix of each downloaded band, its slot and the folder it lies in.
BAND_FILES = {
    "b04": ("_B04_10m.jp2", "IMG_DATA/R10m/"),
    "b08": ("_B08_10m.jp2", "IMG_DATA/R10m/"),
    "tci": ("_TCI_10m.jp2", "IMG_DATA/R10m/"),
    "b11": ("_B11_20m.jp2", "IMG_DATA/R20m/"),
    "b12": ("_B12_20m.jp2", "IMG_DATA/R20m/"),
    "b8a": ("_B8A_20m.jp2", "IMG_DATA/R20m/"),
    "clouds": ("MSK_CLDPRB_20m.jp2", "QI_DATA/"),
}


def seed_tiles(configured: DataFrame, existing: DataFrame) -> DataFrame:
    """Configured tile names (comma lists in ``tiles``) that ``existing`` lacks, as tracked rows."""
    wanted = (configured
              .select(F.explode(F.split("tiles", r"\s*,\s*")).alias("tile_index"))
              .where(F.col("tile_index") != "").distinct())
    missing = wanted.join(existing.select("tile_index"), "tile_index", "left_anti")
    return missing.select("tile_index", F.lit(1).alias("is_tracked"),
                          F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date"))


def tiles_to_backfill(tiles: DataFrame) -> DataFrame:
    return tiles.where((F.col("is_tracked") == 1) & F.col("first_date").isNull())


def tiles_to_update(tiles: DataFrame) -> DataFrame:
    return tiles.where((F.col("is_tracked") == 1) & F.col("first_date").isNotNull())


def scenes_of_tile(paths: DataFrame, tile_name: str) -> DataFrame:
    """Listing rows whose ``path`` lies under the tile's folder."""
    folder = F.concat(F.lit("L2/tiles/"), names.tile_name_to_uri(F.lit(tile_name)), F.lit("/"))
    return paths.where(F.startswith("path", folder))


def first_granule(granules: DataFrame, scene: str = "scene_id", path: str = "path") -> DataFrame:
    """First nested granule folder of each scene without its trailing slash."""
    return granules.groupBy(scene).agg(F.rtrim(F.min(path), F.lit("/")).alias("tile_uri"))


def metadata_percentages(xml: Column) -> tuple[Column, Column]:
    """(nodata, cloud) percentages: the first node of each name in the metadata text.

    Both are plain text nodes, so a pattern match does; building a document tree per node
    and row costs about twenty times as much.
    """
    def first_node(name: str) -> Column:
        text = F.regexp_extract(xml, rf"<{name}(?:\s[^>]*)?>\s*([^<\s]*)\s*</{name}>", 1)
        return text.try_cast("double")

    return first_node("NODATA_PIXEL_PERCENTAGE"), first_node("CLOUDY_PIXEL_PERCENTAGE")


def within_quality(nodata: Column, cloud: Column, max_nodata: float = MAX_NODATA,
                   max_cloud: float = MAX_CLOUD) -> Column:
    """Both limits are strict: a scene exactly at a limit is rejected."""
    return (nodata < max_nodata) & (cloud < max_cloud)


def band_manifest(files: DataFrame, keys: list[str], file: str = "file") -> DataFrame:
    """One row per scene with the path in every band slot.

    ``is_downloaded`` counts filled slots and is -1 when one of the three folders holds no
    file at all. Conditional maxima need a single partially aggregated shuffle.
    """
    path = F.col(file)
    slots = [F.max(F.when(F.endswith(path, F.lit(suffix)), path)).alias(f"{slot}_path")
             for slot, (suffix, _) in BAND_FILES.items()]
    folders = sorted({folder for _, folder in BAND_FILES.values()})
    seen = [F.bool_or(F.contains(path, F.lit(folder))) for folder in folders]
    complete = seen[0]
    for flag in seen[1:]:
        complete = complete & flag
    filled = sum((F.col(f"{slot}_path").isNotNull().cast("int") for slot in BAND_FILES), F.lit(0))
    return (files.groupBy(*keys).agg(*slots, complete.alias("_complete"))
            .withColumn("is_downloaded", F.when(F.col("_complete"), filled).otherwise(-1))
            .drop("_complete"))


def upsert_scenes(existing: DataFrame, incoming: DataFrame, values: list[str]) -> DataFrame:
    """Union of two scene tables keyed (tile_id, image_date).

    A known scene keeps its values and is marked new when it shows up again; an unknown
    one is inserted. One aggregate over the union replaces dedupe plus outer join, and its
    partial step collapses repeated listings before the shuffle. Of several rows with one
    key the smallest value struct wins.
    """
    payload = F.struct(*values)
    known = existing.select("tile_id", "image_date", F.lit(0).alias("_src"), "is_new", payload.alias("_v"))
    fresh = incoming.select("tile_id", "image_date", F.lit(1).alias("_src"), F.lit(1).alias("is_new"),
                            payload.alias("_v"))
    merged = (known.unionByName(fresh).groupBy("tile_id", "image_date")
              .agg(F.min(F.struct("_src", "_v")).alias("_best"), F.max("_src").alias("_seen"),
                   F.max(F.when(F.col("_src") == 0, F.col("is_new"))).alias("_old_new")))
    return merged.select("tile_id", "image_date", *[F.col(f"_best._v.{v}").alias(v) for v in values],
                         F.when(F.col("_seen") == 1, 1).otherwise(F.col("_old_new")).cast("int").alias("is_new"))


def since_start(scenes: DataFrame, start: str = START_DATE) -> DataFrame:
    """Scenes strictly after the start date; order is left to the caller."""
    return scenes.where(F.col("image_date") > F.lit(start).cast("date"))


def since_last(scenes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Scenes on or after their tile's last date; tiles without one are skipped."""
    dim = tiles.where(F.col("last_date").isNotNull()).select("tile_id", "last_date")
    return scenes.join(dim, "tile_id").where(F.col("image_date") >= F.col("last_date"))


def ready_scenes(scenes: DataFrame, paths: list[str]) -> DataFrame:
    """New scenes with every path filled and all seven files downloaded."""
    complete = (F.col("is_downloaded") == len(BAND_FILES)) & (F.col("is_new") == 1)
    for path in paths:
        complete = complete & F.col(path).isNotNull()
    return scenes.where(complete)


def prepared_scenes(scenes: DataFrame, only_new: bool = False) -> DataFrame:
    """Successfully prepared scenes; order is left to the caller."""
    keep = F.col("success") == 1
    return scenes.where(keep & (F.col("is_new") == 1) if only_new else keep)


def state_filter(info: DataFrame, tiles: DataFrame, flags: dict[str, int], source_like: dict[str, str]) -> DataFrame:
    """Rows of tracked tiles in a given state whose path columns contain the given texts."""
    keep = F.lit(True)
    for column, value in flags.items():
        keep = keep & (F.col(column) == value)
    for column, text in source_like.items():
        keep = keep & F.contains(F.col(column), F.lit(text))
    tracked = tiles.where(F.col("is_tracked") == 1).select("tile_id", "tile_index")
    return info.where(keep).join(tracked, "tile_id")


def scene_per_day(scenes: DataFrame, values: list[str]) -> DataFrame:
    """One row per (tile, date): the smallest value struct of the day."""
    return (scenes.groupBy("tile_id", "image_date").agg(F.min(F.struct(*values)).alias("_v"))
            .select("tile_id", "image_date", "_v.*"))


def scene_pairs(daily: DataFrame, values: list[str]) -> DataFrame:
    """Consecutive scenes of a tile as (…_0, …_1); input holds one scene per tile and day."""
    order = Window.partitionBy("tile_id").orderBy("image_date")
    after = F.lead(F.struct("image_date", *values)).over(order)
    return (daily.withColumn("_next", after).where(F.col("_next").isNotNull())
            .select("tile_id", F.col("image_date").alias("image_date_0"),
                    F.col("_next.image_date").alias("image_date_1"),
                    *[F.col(v).alias(f"{v}_0") for v in values],
                    *[F.col(f"_next.{v}").alias(f"{v}_1") for v in values]))


def carry_baseline(daily: DataFrame) -> DataFrame:
    """After pairing only a tile's newest scene stays new, as the baseline of the next run.

    A tile with a single scene forms no pair and keeps its flag.
    """
    newest = F.max("image_date").over(Window.partitionBy("tile_id"))
    return daily.withColumn("is_new", F.when(F.col("image_date") < newest, 0).otherwise(F.col("is_new")))


def skip_done(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs without a stored result."""
    return pairs.join(results, ["tile_id", "image_date_0", "image_date_1"], "left_anti")


def extend_tile_dates(tiles: DataFrame, tasks: DataFrame) -> DataFrame:
    """Widen first/last date of each tile by its finished tasks."""
    span = tasks.groupBy("tile_id").agg(F.min("image_date_0").alias("_lo"), F.max("image_date_1").alias("_hi"))
    return (tiles.join(span, "tile_id", "left")
            .withColumn("first_date", F.least("first_date", "_lo"))
            .withColumn("last_date", F.greatest("last_date", "_hi")).drop("_lo", "_hi"))


def apply_updates(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with the non-null values of at most one update row per key."""
    fresh = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in columns])
    return (base.join(fresh, key, "left")
            .withColumns({c: F.coalesce(F.col(f"_u_{c}"), F.col(c)) for c in columns})
            .drop(*[f"_u_{c}" for c in columns]))


def pending_tasks(tasks: DataFrame) -> DataFrame:
    """Open and finished task counts per tile."""
    done = F.col("date_finished").isNotNull()
    return tasks.groupBy("tile_id").agg(F.count_if(~done).alias("pending"), F.count_if(done).alias("finished"))


def derive_states(scenes: DataFrame, stages: dict[str, DataFrame], failures: DataFrame) -> DataFrame:
    """State flags of each scene from the outputs of its stages.

    A stage flag is 1 when the stage produced the scene, -1 when ``failures`` names the
    (scene, stage), else 0. One aggregate over tagged rows covers all stages.
    """
    tagged = scenes.select("scene_id", F.lit("").alias("stage"), F.lit(0).alias("ok"))
    for stage, output in stages.items():
        tagged = tagged.unionByName(output.select("scene_id", F.lit(stage).alias("stage"), F.lit(1).alias("ok")))
    tagged = tagged.unionByName(failures.select("scene_id", "stage", F.lit(-1).alias("ok")))
    flags = [F.coalesce(F.min(F.when(F.col("stage") == stage, F.col("ok"))), F.lit(0)).alias(f"is_{stage}")
             for stage in stages]
    known = F.bool_or(F.col("stage") == "")
    return tagged.groupBy("scene_id").agg(*flags, known.alias("_known")).where("_known").drop("_known")

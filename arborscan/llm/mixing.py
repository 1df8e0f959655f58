"""Mixing sources by temperature: exponentiated token shares, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborscan.llm.common import stored

MAX_REPEATS, BLOCK_TOKENS, STEPS = 2.0, 1 << 20, 50


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights(totals: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> DataFrame:
    """(source, tokens, weight, budget, alpha) for token totals (source, tokens).

    A source's weight is its share to the power ``alpha``, normalised. ``alpha`` is bisected in
    [0, 1]: the least for which no source is repeated more than ``max_repeats`` times, or, with
    ``entropy`` (nats), the largest whose weights reach that entropy. The budget is the least for
    which every source has at least one whole pass: no document is left out. Sources without
    tokens have weight and budget 0. All arithmetic is on one row of totals, one entry per source.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give a repetition limit or an entropy")
    grouped = totals.agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("all"))
    logs = F.transform(F.filter("all", lambda s: s["tokens"] > 0), lambda s: F.log(s["tokens"].cast("double")))
    ready = grouped.withColumn("logs", logs).withColumn("high", F.array_max("logs")).withColumn("low", F.array_min("logs"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)

    def fits(alpha: Column) -> Column:
        if entropy is None:  # the smallest source is repeated most, the largest once
            return (1 - alpha) * (F.col("high") - F.col("low")) <= math.log(max_repeats)
        scaled = F.transform("logs", lambda x: F.exp(alpha * (x - F.col("high"))))
        mass = total(scaled)
        return F.log(mass) - total(F.transform("logs", lambda x: F.exp(alpha * (x - F.col("high"))) * alpha * (x - F.col("high")))) / mass >= entropy

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        met = fits(middle)
        keep_high = met if entropy is None else ~met
        return F.when(keep_high, F.struct(acc["low"].alias("low"), middle.alias("high"))).otherwise(
            F.struct(middle.alias("low"), acc["high"].alias("high")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)
    alpha = ends["high"] if entropy is None else F.when(fits(F.lit(1.0)), 1.0).otherwise(ends["low"])
    solved = ready.withColumn("alpha", F.round(alpha, 9)).withColumn(
        "mass", total(F.transform("logs", lambda x: F.exp(F.col("alpha") * (x - F.col("high"))))))
    one = solved.select(F.explode("all").alias("s"), "alpha", "mass", "high")
    tokens = F.col("s.tokens").cast("double")
    weight = F.when(tokens > 0, F.exp(F.col("alpha") * (F.log(tokens) - F.col("high"))) / F.col("mass")).otherwise(0.0)
    # the largest source makes one pass: budget in all = its tokens / its weight, which is its tokens times the mass
    return one.select("s.source", "s.tokens", weight.alias("weight"), "alpha",
                      F.coalesce(F.greatest(F.col("s.tokens"), F.floor(weight * F.exp("high") * F.col("mass") + 0.5)), F.lit(0)).cast("long").alias("budget"))


def mix(docs: DataFrame, tokens: str = "n_tokens", seed: str = "mix", max_repeats: float | None = MAX_REPEATS,
        entropy: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` (doc_id, source, the ``tokens`` column, more) once per chosen copy, plus (epoch, block, place).

    Every pass over a source is a permutation of its documents by md5 of seed, pass and id. The
    passes lie on one line of tokens; a document is in if it starts before the source's budget, so
    all passes but the last are whole and the last is cut at the budget. The line is laid out over
    blocks: block b of the mixture takes, from each source, the part of ``block_tokens`` that the
    source's weight gives it. ``place`` is the hash that orders documents inside a block.

    A null source counts as the source ''. Documents without tokens (null counts as 0) come once.
    Rows with equal (doc_id, source, tokens) are placed one after another; other columns ride along
    (but those called epoch, block or place, which the new ones replace). Running sums go over hash buckets first (4,096 per source and pass),
    then inside a bucket, so a source of any size is spread. An empty table gives an empty one.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", tokens, "epoch", "block", "place")]
    key = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"),
                      F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"), F.struct(*extra).alias("rest"))
    plan = stored(weights(key.groupBy("source").agg(F.sum("tokens").alias("tokens")), max_repeats, entropy)
                  .withColumnRenamed("tokens", "available"), "mixture")
    planned = key.join(plan, "source")
    passes = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.greatest("available", F.lit(1)))).cast("int")
    copies = planned.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    copies = copies.where("tokens > 0 OR epoch = 0").withColumn(
        "place", F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    copies = copies.withColumn("bucket", F.substring("place", 1, 3))
    sums = copies.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    earlier = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    line = copies.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(bases, ["source", "epoch", "bucket"])
    start = F.col("epoch") * F.col("available") + F.col("base") + F.col("before")
    chosen = line.withColumn("start", start).where("start < budget OR tokens = 0")
    share = F.greatest(F.lit(1.0), F.col("weight") * block_tokens)
    return chosen.withColumn("block", F.floor(F.col("start") / share).cast("long")).select(
        "doc_id", F.col("tokens").alias(tokens), "rest.*", "epoch", "block", "place")

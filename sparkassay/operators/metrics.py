"""Measures of runs: percentiles, match rates, gates, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUR_HOURS = 14_400


#: Cells of a group's sorted values, cut at its own quantiles.
CELLS = 64


def nearest_rank(values: DataFrame, by: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank from below: place floor((n - 1) * p) of the sorted values.

    Equal values are counted first.  A group's distinct values are cut into cells at approximate quantiles; the cells' sizes
    tell which of them hold the places asked for, and only these are sorted, each by itself.  So a group of any size is
    sorted by many tasks, and most of it by none; the places are exact wherever the cuts fall.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("by"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = counted.groupBy(F.col("by").alias("of")).agg(F.percentile_approx("v", [i / CELLS for i in range(1, CELLS)], 1000).alias("cuts"))
    celled = counted.join(cuts, F.col("by").eqNullSafe(F.col("of"))).select("by", "v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("cell"))
    order = Window.partitionBy("by").orderBy("cell")  # CELLS rows a group
    cells = celled.groupBy("by", "cell").agg(F.sum("c").alias("s")).withColumns({"upto": F.sum("s").over(order), "n": F.sum("s").over(Window.partitionBy("by"))})
    place = {name: F.floor((F.col("n") - 1) * F.lit(p)) for name, p in fractions.items()}
    wanted = F.lit(False)
    for x in place.values():
        wanted = wanted | (F.col("upto") > x) & (F.col("upto") - F.col("s") <= x)
    wanted = cells.filter(wanted).select(F.col("by").alias("of"), F.col("cell").alias("at"), (F.col("upto") - F.col("s")).alias("before"), "n")
    inside = celled.join(wanted, F.col("by").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at")))
    placed = inside.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("by", "cell").orderBy("v")))
    out = placed.groupBy("by").agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > x, F.col("v"))).alias(name) for name, x in place.items()))
    return out.withColumnRenamed("by", by)


def phase(iteration: Column) -> Column:
    return F.when(iteration % 2 == 1, "fixed_seed_reproducibility").otherwise("varied_seed_robustness")


def matches(signatures: DataFrame) -> DataFrame:
    """Each question's signatures against its run's baseline, the first fixed iteration.

    signatures: question_id, iteration, retrieval, answer.  The baseline is not compared with itself, and
    iterations before it are left out.
    """
    marked = signatures.withColumn("phase", phase(F.col("iteration")))
    start = marked.filter("phase = 'fixed_seed_reproducibility'").agg(F.min("iteration").alias("start"))
    later = marked.crossJoin(F.broadcast(start))  # one row
    base = later.filter("iteration = start").select("question_id", F.col("retrieval").alias("r0"), F.col("answer").alias("a0"))
    return later.filter("iteration > start").join(base, "question_id").select("question_id", "iteration", "phase", "answer", (F.col("retrieval") == F.col("r0")).alias("same_retrieval"), (F.col("answer") == F.col("a0")).alias("same_answer"))


def match_rates(compared: DataFrame) -> DataFrame:
    """(phase, comparisons, retrieval_rate, answer_rate)."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 8)
    return compared.groupBy("phase").agg(F.count("*").alias("comparisons"), rate("same_retrieval").alias("retrieval_rate"), rate("same_answer").alias("answer_rate"))


def distinct_answers(compared: DataFrame) -> DataFrame:
    """One row: the sum over questions of different answers in varied iterations."""
    each = compared.filter("phase = 'varied_seed_robustness'").groupBy("question_id").agg(F.count_distinct("answer").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unique_signatures"))


def soak_gate(total: Column, fixed: Column, varied: Column, short_test: bool = False) -> Column:
    """Whether a soak run counts: long enough, with two fixed phases and a varied one."""
    long, phases = total >= FOUR_HOURS, (fixed >= 2) & (varied >= 1)
    passed = F.lit(short_test) | long & phases
    reasons = F.concat_ws(",", F.when(~long, "duration_below_14400"), F.when(~phases, "phase_coverage_insufficient"))
    return F.struct(long.alias("duration_gate_passed"), phases.alias("phase_gate_passed"), passed.alias("formal_gate_passed"), F.when(passed, F.lit("completed")).otherwise(reasons).alias("exit_reason"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, share) of each value."""
    counted = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("total"), 8).alias("share"))  # one row


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Wilson interval of a share; null without cases."""
    p = hits / n
    middle, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, F.struct(F.round((middle - spread) / scale, 8).alias("low"), F.round((middle + spread) / scale, 8).alias("high")))


def bootstrap(groups: DataFrame, hits: str, n: str, resamples: int = 200, seed: int = 7, digits: int = 8) -> DataFrame:
    """One row: the share of hits, and the middle 95 % of it over resamples of whole groups (clusters) with replacement.

    groups: one row each, with whole numbers `hits` of `n`.  A group's weight in a resample is a Poisson(1) draw from a hash of its
    columns, so resamples are sums in one pass, combined before their shuffle, and can be repeated anywhere.
    """
    key = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in sorted(groups.columns))), 256)
    # each resample's draw: the first 13 hexadecimal digits of the digest of the group's and its number
    drawn = groups.withColumn("key", key).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), "key", F.col("i").cast("string")), 256)
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    weight, upto, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(12):  # Poisson(1) exceeds 12 once in 10^10 draws
        upto += p
        weight = weight + (u >= upto).cast("int")
        p /= k + 1
    drawn = drawn.withColumn("w", weight).groupBy("i").agg(F.sum(F.col("w") * F.col(hits)).alias("h"), F.sum(F.col("w") * F.col(n)).alias("m"))
    rates = drawn.filter("m > 0").select(F.lit(0).alias("one"), F.round(F.col("h") / F.col("m"), digits).alias("rate"))
    middle = nearest_rank(rates, "one", "rate", {"low": 0.025, "high": 0.975}).select("low", "high")
    whole = groups.agg(F.sum(hits).alias("h"), F.sum(n).alias("m"), F.count("*").alias("clusters"))
    return whole.join(middle, F.lit(True), "left").select("clusters", F.round(F.col("h") / F.col("m"), digits).alias("rate"), "low", "high")  # one row each


def stage_gates(coverage: Column, success: Column, unsupported: Column, unsure: Column, external: Column) -> Column:
    """Reasons to stop a stage, in a fixed order."""
    return F.concat_ws(",", F.when(coverage < 0.5, "coverage_below_50"), F.when(success < 0.7, "success_below_70"), F.when(unsupported > 0.05, "unsupported_above_5"), F.when(unsure > 0.3, "unsure_above_30"), F.when(external > 0, "external_requests"))


def stratified(rows: DataFrame, by: str, key: str, seed: int, size: int = 20) -> DataFrame:
    """At most `size` rows of each stratum, by a seeded hash of their key."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy(by).orderBy(order, key))
    return rows.withColumn("place", place.cast("bigint")).filter(F.col("place") <= size)


def transform_verdict(reviews: DataFrame, by: str, value: str, unsure: int = 2) -> DataFrame:
    """(by, reviewed, n, u, rejected) of a reviewed sample: one N, or more than `unsure` U, rejects the whole transform."""
    counted = reviews.groupBy(by).agg(F.count("*").alias("reviewed"), F.count_if(F.col(value) == "N").alias("n"), F.count_if(F.col(value) == "U").alias("u"))
    return counted.withColumn("rejected", (F.col("n") > 0) | (F.col("u") > unsure))


def pooled(cards: DataFrame) -> DataFrame:
    """(measure, arm, kind, targets, yes, no, unsure, unjudged, lower, upper, estimate) from pools that are judged in part.

    cards (measure, arm, kind, target, stratum, value): a target holds if one of its cards is Y, and does not if all are N.  A
    target with a card nobody judged is unjudged, else one with a U unsure; they bound the rate.  The estimate gives their open cards
    the share of Y among the judged of their stratum, and nothing where a stratum has neither Y nor N.
    """
    rate = cards.groupBy("measure", "stratum").agg(F.coalesce(F.try_divide(F.sum((F.col("value") == "Y").cast("double")), F.sum(F.col("value").isin("Y", "N").cast("double"))), F.lit(0.0)).alias("p"))
    each = cards.join(rate, ["measure", "stratum"])
    open_ = F.col("value").isNull() | (F.col("value") == "U")
    targets = each.groupBy("measure", "arm", "kind", "target").agg(
        F.max((F.col("value") == "Y").cast("int")).alias("yes"),
        F.max(F.col("value").isNull().cast("int")).alias("unjudged"),
        F.max((F.col("value") == "U").cast("int")).alias("unsure"),
        F.exp(F.sum(F.when(open_, F.ln(F.greatest(1 - F.col("p"), F.lit(1e-12)))).otherwise(0.0))).alias("none"),
    )
    yes, unjudged, unsure = (F.coalesce(F.col(c), F.lit(0)) == 1 for c in ("yes", "unjudged", "unsure"))
    state = F.when(yes, "yes").when(unjudged, "unjudged").when(unsure, "unsure").otherwise("no")
    chance = F.when(yes, 1.0).when(unjudged | unsure, 1 - F.col("none")).otherwise(0.0)
    judged = targets.select("measure", "arm", "kind", state.alias("state"), chance.alias("chance"))
    counts = [F.count_if(F.col("state") == c).alias(c) for c in ("yes", "no", "unsure", "unjudged")]
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return judged.groupBy("measure", "arm", "kind").agg(F.count("*").alias("targets"), *counts, share(F.col("state") == "yes").alias("lower"), share(F.col("state") != "no").alias("upper"), share(F.col("chance")).alias("estimate"))

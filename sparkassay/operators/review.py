"""Review: the queue, the event log and what is left of it, approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.functions import text as T
from sparkassay.operators.runlog import numbered

KEY = ["question_id", "target_type", "target_id"]


def queue(fixtures: DataFrame) -> DataFrame:
    """One reference item for each cluster, before its first query item; a query item for each row.

    fixtures: question_id, fact_cluster_id, pos (their order).
    """
    first = Window.partitionBy("fact_cluster_id").orderBy("pos", "question_id")
    ranked = fixtures.withColumn("i", F.row_number().over(first))
    reference = ranked.filter("i = 1").select("pos", F.lit(0).alias("kind"), "question_id", F.lit("reference_supported").alias("target_type"), F.col("fact_cluster_id").alias("target_id"))
    query = fixtures.select("pos", F.lit(1).alias("kind"), "question_id", F.lit("query_natural").alias("target_type"), F.col("question_id").alias("target_id"))
    return reference.unionByName(query)


def reduce_events(events: DataFrame, *columns: str) -> DataFrame:
    """Labels that stand: the last event of each key, if it is a label.

    events: KEY, seq, action (label or undo) and the label's columns.  An undo of nothing changes nothing.
    """
    last = events.groupBy(*KEY).agg(F.max_by(F.struct("seq", "action", *columns), "seq").alias("e"))
    return last.filter(F.col("e.action") == "label").select(*KEY, "e.seq", *(f"e.{c}" for c in columns))


def label_order(active: DataFrame) -> DataFrame:
    """Standing labels with their place in the order of their last label, as the undo stack has them."""
    return numbered(active, "seq", *KEY).withColumnRenamed("number", "place")


def overlay(active: DataFrame, prelabels: DataFrame) -> DataFrame:
    """Standing labels, and the first prelabel of each key that has none (prelabels: KEY, pos, value, decision_source)."""
    new = prelabels.join(active.select(*KEY), KEY, "left_anti").groupBy(*KEY).agg(F.min_by(F.struct("value", "decision_source"), "pos").alias("p"))
    return active.select(*KEY, "value", F.lit("human").alias("decision_source")).unionByName(new.select(*KEY, "p.value", "p.decision_source"))


def orphans(prelabels: DataFrame, items: DataFrame) -> DataFrame:
    """Prelabels of keys that the queue does not have."""
    return prelabels.join(items.select(*KEY), KEY, "left_anti")


def complete_clusters(fixtures: DataFrame, kinds: list[str]) -> DataFrame:
    """(fact_cluster_id, complete): whether a cluster has exactly the kinds."""
    return fixtures.groupBy("fact_cluster_id").agg(F.array_sort(F.collect_set("query_kind")).alias("kinds")).select("fact_cluster_id", (F.col("kinds") == F.array(*map(F.lit, sorted(kinds)))).alias("complete"))


def approved(fixtures: DataFrame, labels: DataFrame, size: int = 4) -> DataFrame:
    """Clusters whose reference and exactly `size` different questions are all labelled Y."""
    value = labels.groupBy("target_type", "target_id").agg(F.max_by("value", "seq").alias("value"))
    query = value.filter("target_type = 'query_natural'").select(F.col("target_id").alias("question_id"), F.col("value").alias("q"))
    reference = value.filter("target_type = 'reference_supported' and value = 'Y'").select(F.col("target_id").alias("fact_cluster_id"))
    fine = fixtures.join(query, "question_id", "left").groupBy("fact_cluster_id").agg(F.count_distinct("question_id").alias("n"), F.min(F.coalesce(F.col("q") == "Y", F.lit(False))).alias("all_y"))
    return fine.filter((F.col("n") == size) & F.col("all_y")).join(reference, "fact_cluster_id", "left_semi").select("fact_cluster_id")


def rejected_outright(query: Column, answer: Column) -> Column:
    """A query that needs no judge: an ideograph, the answer inside it, or under three characters."""
    q, a = T.joined_key(query), T.joined_key(answer)
    return query.rlike("[\\u4e00-\\u9fff]") | (F.length(a) >= 8) & F.contains(q, a) | (F.length(T.collapse_ends(query)) < 3)


def consensus(rejected: Column, first: Column, second: Column) -> Column:
    """What two judges settle: N with its source and confidence, or null for an uncertain case.  Never Y."""
    both = F.coalesce((first == "N") & (second == "N"), F.lit(False))
    found = lambda source, sure: F.struct(F.lit("N").alias("value"), F.lit(source).alias("decision_source"), F.lit(sure).alias("confidence"))
    return F.when(F.coalesce(rejected, F.lit(False)), found("deterministic", 1.0)).when(both, found("local_model_consensus", 0.8))

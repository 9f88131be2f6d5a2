"""Queries p1, p2, p6, p7 and p8 over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.functions.numbers import exact_time, number, number_text
from sigtrace.llm.components import connected_groups, dashed, text_key, uuid_key
from sigtrace.llm.leakage import leaked_items
from sigtrace.llm.mixing import Mix, mix_sources
from sigtrace.llm.runs import collapse_runs
from sigtrace.llm.sentences import sentence_units
from sigtrace.operators.dedup import first_copies
from sigtrace.plans.records import pfcp_key
from sigtrace.sources.shared import RunFolder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pfcp_event() -> Column:
    """The event of a PFCP message: heartbeat or its type; null if it has neither."""
    n = number(F.col("msg_type"))
    return (
        F.when(n.isin(1, 2), "heartbeat")
        .when(n.isNotNull(), F.concat(F.lit("type "), number_text(F.col("msg_type"))))
        .when(F.col("is_heartbeat"), "heartbeat")
    )


PEERS = ["analysis_id", "peer_a", "peer_b"]
ORDER = ["time", "frame", "seq_num", "seid"]


def pfcp_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each PFCP message once, with its peers, exact time (null if it has none), event and what kind of event it is."""
    m = table(spark, sf_dir, "pfcp_messages")
    peers = [F.coalesce(F.col(f"transport.{c}_ip"), F.lit("")) for c in ("src", "dst")]
    keys = dict(zip(("analysis_id", "frame", "seq", "se"), pfcp_key()))
    take = {"time": exact_time(F.col("time_epoch")), "event": pfcp_event(), "peer_a": F.least(*peers), "peer_b": F.greatest(*peers)}
    once = first_copies(m, keys, ["received_at", "row_id"], take)
    return once.withColumn("seq_num", number(F.col("seq"))).withColumn("seid", number(F.col("se")))


def pfcp_runs(once: DataFrame, folder: RunFolder) -> DataFrame:
    """The runs of each pair of peers as one event each, of messages with a time."""
    return collapse_runs(once.filter("time is not null"), PEERS, ORDER, "event", "time", ["frame"], folder=folder)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = pfcp_runs(pfcp_once(spark, sf_dir), RunFolder(spark, "runs"))
    return runs.filter("n_events >= 2").select("analysis_id", "first_frame", "last_frame")


RUN_COLUMNS = [*PEERS, "event", "n_events", "duration", "first_time", "last_time", "first_frame", "last_frame"]


def untimed(once: DataFrame) -> DataFrame:
    """Messages without a readable time have no place in a sequence: an event of its own each, without duration."""
    none = F.lit(None).cast("decimal(38,18)")
    return once.filter("time is null").select(*PEERS, "event", F.lit(1).cast("bigint").alias("n_events"), none.alias("duration"), none.alias("first_time"), none.alias("last_time"), F.col("frame").alias("first_frame"), F.col("frame").alias("last_frame"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in one event: runs with count and duration, single events and messages without a time too."""
    folder = RunFolder(spark, "runs")
    once = folder.write(pfcp_once(spark, sf_dir), "once")
    runs = pfcp_runs(once, folder).withColumn("duration", F.col("duration").cast("decimal(38,18)"))
    return runs.select(*RUN_COLUMNS).unionByName(untimed(once))


def p1_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-identical stretches as one event: a heartbeat among session messages (or the reverse) weighs 1, another type
    of the same kind 0.5, a boundary 1, so what departs for a moment is bridged and counted in ``n_unlike``."""
    kind = F.when(F.col("event") == "heartbeat", "heartbeat").when(F.col("event").isNotNull(), "other")
    once = pfcp_once(spark, sf_dir).filter("time is not null").withColumn("kind", kind)
    runs = collapse_runs(once, PEERS, ORDER, {"kind": 1.0, "event": 0.5}, "time", ["frame"], penalty=1.0)
    return runs.withColumn("duration", F.col("duration").cast("decimal(38,18)"))


def linking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The edges that link observations, and the observations' ids."""
    accepted = F.col("decision").isin("accepted", "accepted_with_warning") & (F.col("edge_effect") == "union_same_type")
    return table(spark, sf_dir, "identity_edges").filter(accepted), table(spark, sf_dir, "identity_observations").select("observation_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, known = linking(spark, sf_dir)
    groups = connected_groups(edges, "left_observation_id", "right_observation_id", known, uuid_key)
    return groups.select(dashed(F.col("group_id")).alias("group_id"), dashed(F.col("id")).alias("observation_id"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation with the identifier of its whole linked group, those without a link with their own."""
    edges, known = linking(spark, sf_dir)
    groups = connected_groups(edges, "left_observation_id", "right_observation_id", known, text_key, singles=True)
    return groups.select(dashed(F.col("group_id")).alias("group_id"), dashed(F.col("id")).alias("observation_id"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leak with the place of a passage in the document's original text, and of the item's answer behind it."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), answer="answer")


def mix(spark: SparkSession, sf_dir: str) -> Mix:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of each mix in the order of training."""
    return mix(spark, sf_dir).ordered


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is in each mix."""
    return mix(spark, sf_dir).copies.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("copies"), F.first("n_tokens").alias("n_tokens"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    return mix(spark, sf_dir).shares


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents")).select("doc_id", "start_pos", "end_pos")


QUERIES = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p1_similar": p1_similar,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p6_found": p6_found,
    "p6_passages": p6_passages,
    "p7_mix": p7_mix,
    "p7_copies": p7_copies,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
}

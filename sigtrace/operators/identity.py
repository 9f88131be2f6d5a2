"""Identities as a graph: observations, edges, nodes, conflicts, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrace.operators.ordered import with_neighbour, with_position
from sigtrace.operators.skew import join_hot
from sigtrace.operators.transactions import earliest

# The node type of each kind of identifier; all others are PFCP_SESSION.
NODE_TYPES = {
    "UE": ["supi", "suci", "gpsi", "guti", "pei"],
    "ACCESS_CONTEXT": ["amf_ue_ngap_id", "ran_ue_ngap_id"],
    "PDU_SESSION": ["pdu_session_id"],
    "SM_CONTEXT": ["sm_context_ref"],
}


# The role of each node type.
ROLES = {"UE": "UE", "ACCESS_CONTEXT": "ACCESS_CONTEXT", "PDU_SESSION": "SESSION", "SM_CONTEXT": "SESSION", "PFCP_SESSION": "USER_PLANE"}


def role(kind: Column) -> Column:
    """What an identifier of a kind stands for; null for null."""
    table = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.when(kind.isNotNull(), table[node_type(kind)])


def scope_key(kind: Column, access: Column, src: Column, dst: Column, frame: Column) -> Column:
    """Where a value of a kind is unique: a subscriber's anywhere, an access context's between two endpoints in that
    direction, a session's within its access context, any other in its frame. Missing parts are ``unknown``."""
    or_unknown = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return (
        F.when(kind.isin(NODE_TYPES["UE"]), F.concat(kind, F.lit(":subscriber")))
        .when(kind.isin(NODE_TYPES["ACCESS_CONTEXT"]), F.concat_ws(":", kind, or_unknown(src), or_unknown(dst)))
        .when(kind.isin("pdu_session_id", "procedure_transaction_id", "sm_context_ref"), F.concat(kind, F.lit(":access:"), or_unknown(access)))
        .otherwise(F.concat(kind, F.lit(":frame:"), or_unknown(frame)))
    )


def nodes_of_events(events: DataFrame, obs: DataFrame, members: DataFrame, event: str = "event_id") -> DataFrame:
    """``event, node_id, node_type``: the distinct nodes of each event, by its observations.

    ``obs`` has ``event`` and ``observation_id``, ``members`` ``observation_id``,
    ``node_id``, ``node_type``. Two equi-joins; events without nodes have a row
    with nulls.
    """
    n = obs.select(event, "observation_id").distinct().join(members.select("observation_id", "node_id", "node_type").distinct(), "observation_id").select(event, "node_id", "node_type").distinct()
    return events.select(event).distinct().join(n, event, "left")


def node_type(kind: Column) -> Column:
    c = None
    for name, kinds in NODE_TYPES.items():
        c = F.when(kind.isin(kinds), name) if c is None else c.when(kind.isin(kinds), name)
    return c.otherwise("PFCP_SESSION")


def to_long(events: DataFrame, ids: list[str], kinds: list[str]) -> DataFrame:
    """Wide identifiers as rows ``kind``, ``lookup_value``; null and empty ones give none."""
    w = events.select(*ids, *[F.col(k).cast("string").alias(k) for k in kinds])
    return w.unpivot(ids, kinds, "kind", "lookup_value").filter("lookup_value is not null and lookup_value != ''")


def observations(long: DataFrame, by: list[str]) -> DataFrame:
    """One row per event, kind and value."""
    return long.dropDuplicates([*by, "kind", "lookup_value"])


BLOCK = 1 << 16  # frames of one block of an identifier's observations


def chain(obs: DataFrame, by: list[str], frame: str, ident: str) -> DataFrame:
    """Edges between consecutive observations (by ``frame``, then id) of one identifier: a spanning chain instead of all pairs."""
    n = with_neighbour(obs, by, F.floor(F.col(frame) / BLOCK), [frame, ident], F.col(ident), "right_id", after=True)
    return n.select(*by, F.col(ident).alias("left_id"), "right_id").filter("right_id is not null")


def star(obs: DataFrame, event: str, key: str) -> DataFrame:
    """Edges ``a, b`` that connect all keys of an event: from its smallest key to each, itself too.

    As many as there are distinct keys of events, where all pairs would grow with
    the square; an event with a third of all rows is spread over tasks.
    """
    o = obs.filter(F.col(event).isNotNull() & F.col(key).isNotNull()).select(event, key).distinct()
    hubs = o.groupBy(event).agg(F.min(key).alias("_hub"), F.count("*").alias("size"))
    return join_hot(o, hubs, event, "_hub", key).select(F.col("_hub").alias("a"), F.col(key).alias("b")).distinct()


def linked(obs: DataFrame, event: str, kind: str) -> DataFrame:
    """Pairs of observations linked by a common event, per event, ``left_kind`` and ``right_kind``: ``n_pairs``.

    Observations of different node types are linked, and those of access
    contexts also with each other, of one kind too. Left is the lesser by node
    type, then kind. An event's pairs of two kinds are the product of its counts
    of each, so none are built and a large event costs no more than a small one.
    """
    n = obs.groupBy(event, kind).agg(F.count("*").alias("_n")).select(event, F.struct(node_type(F.col(kind)).alias("t"), F.col(kind).alias("k"), F.col("_n").alias("n")).alias("_x"))
    each = n.groupBy(event).agg(F.collect_list("_x").alias("_x"))  # as many as there are kinds
    pair = each.select(event, F.explode("_x").alias("a"), "_x").select(event, "a", F.explode("_x").alias("b"))
    same = F.col("a.k") == F.col("b.k")
    access = (F.col("a.t") == "ACCESS_CONTEXT") & (F.col("b.t") == "ACCESS_CONTEXT")
    pair = pair.filter((F.col("a.t") < F.col("b.t")) | (access & (F.col("a.k") <= F.col("b.k"))))
    pairs = F.when(same, F.expr("a.n * (a.n - 1) div 2")).otherwise(F.col("a.n") * F.col("b.n"))
    return pair.select(event, F.col("a.k").alias("left_kind"), F.col("b.k").alias("right_kind"), pairs.alias("n_pairs")).filter("n_pairs > 0")


def node_table(obs: DataFrame, key: list[str]) -> DataFrame:
    """Nodes: first and last frame and time, provisional if any observation is, and how many there are."""
    return obs.groupBy(*key).agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        F.coalesce(F.bool_or("provisional"), F.lit(False)).alias("provisional"),
        F.count_distinct("observation_id").alias("n_observations"),
    )


def aliases(nodes: DataFrame, kind: str, frame: str, ident: str) -> DataFrame:
    """A readable name per node: its type and its number within the type, by ``frame``, then id."""
    n = with_position(nodes, [kind], F.floor(F.col(frame) / BLOCK), [frame, ident], "_n")
    return n.withColumn("display_alias", F.concat(F.col(kind), F.lit("-"), F.col("_n"))).drop("_n")


def conflicts(bindings: DataFrame, left: str, right: str, order: list[Column]) -> DataFrame:
    """Left ids bound to more than one right id: how many, and the first."""
    return bindings.filter(F.col(right).isNotNull()).groupBy(left).agg(F.count_distinct(right).alias("n_values"), earliest(F.col(right), *order).alias("first_value")).filter("n_values > 1")


def bound_conflicts(left: DataFrame, right: DataFrame, event: str) -> DataFrame:
    """Keys bound to more than one value by common events: ``k``, ``kind``, ``n_values``, ``first_value`` by frame, then value.

    ``left`` has distinct ``event``, ``k``, ``frame`` and ``right`` distinct
    ``event``, ``kind``, ``value``. A key starts from the number of values of
    its largest event and only values of its other events are looked up in that
    one, so no pairs are built of a large event and the keys that it alone has.
    """
    sizes = right.groupBy(event, "kind").agg(F.count("*").alias("n"), F.min("value").alias("first"))
    b = left.join(sizes, event)
    g = b.groupBy("k", "kind").agg(F.max(F.struct("n", F.col(event).alias("event"))).alias("base"), F.count("*").alias("_events"), earliest(F.col("first"), F.col("frame"), F.col("first")).alias("first_value"))
    more = g.filter("_events > 1").select("k", "kind", F.col("base.event").alias("_base"))
    rest = b.select("k", "kind", event).join(more, ["k", "kind"]).filter(F.col(event) != F.col("_base")).join(right, [event, "kind"]).select("k", "kind", "_base", "value").distinct()
    held = right.select(F.col(event).alias("_base"), "kind", "value")
    extra = rest.join(held, ["_base", "kind", "value"], "left_anti").groupBy("k", "kind").agg(F.count("*").alias("_more"))
    n = g.join(extra, ["k", "kind"], "left").select("k", "kind", (F.col("base.n") + F.coalesce("_more", F.lit(0))).alias("n_values"), "first_value")
    return n.filter("n_values > 1")

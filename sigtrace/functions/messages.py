"""Outcomes, causes and bodies of signalling messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtrace.functions.numbers import number_text
from sigtrace.functions.text import any_of


def first_int(value: Column) -> Column:
    """A value found by its key as a BIGINT, decimal or hexadecimal; null if it is no integer."""
    return number_text(value).try_cast("bigint")


def pdu_class(tree: Column) -> Column:
    """The class of an NGAP message by its tree's text; unsuccessful outcomes are looked for first, as their name holds the other's."""
    t = F.lower(tree.cast("string"))
    has = lambda w: F.coalesce(F.contains(t, F.lit(w.lower())), F.lit(False))
    return F.when(has("unsuccessfulOutcome"), "unsuccessfulOutcome").when(has("successfulOutcome"), "successfulOutcome").when(has("initiatingMessage"), "initiatingMessage")


def pdu_outcome(kind: Column) -> Column:
    return F.when(kind == "unsuccessfulOutcome", "failure").when(kind == "successfulOutcome", "success").when(kind == "initiatingMessage", "request").otherwise("unknown")


def reply_outcome(response_to: Column, response_in: Column, tree: Column) -> Column:
    """The outcome of a PFCP message: a reply fails if its tree speaks of rejects, failures or errors; what is replied to is a request."""
    bad = F.coalesce(any_of(F.lower(tree.cast("string")), ["reject", "failure", "error"]), F.lit(False))
    return F.when(response_to.isNotNull(), F.when(bad, "failure").otherwise("success")).when(response_in.isNotNull(), "request").otherwise("unknown")


# PFCP causes that mean success, and failure; then words of failures.
REPLY_GOOD = ["1", "request_accepted", "accepted", "success", "successful"]
REPLY_BAD = ["64", "request_rejected", "rejected", "failure", "failed"]
REPLY_BAD_WORDS = ["reject", "fail", "denied", "error", "invalid", "mandatory_ie_missing", "no_resources"]


def reply_cause_class(cause: Column, others: str = "unknown") -> Column:
    """success, failure or unknown of a PFCP cause; unknown for none, ``others`` for codes that say neither."""
    c = F.lower(F.trim(F.coalesce(cause.cast("string"), F.lit(""))))
    return F.when(c.isin(REPLY_GOOD), "success").when(c.isin(REPLY_BAD) | any_of(c, REPLY_BAD_WORDS), "failure").when(c.isin("", "none"), "unknown").otherwise(others)


# Words of messages and causes that speak of an unreachable subscriber.
REACHABILITY = ["paging", "not_reachable", "unreachable", "mobile_terminated", "mt_delivery"]


def speaks_of_reachability(message: Column, cause: Column) -> Column:
    both = F.lower(F.concat_ws(" ", message.cast("string"), cause.cast("string")))
    return any_of(both, REACHABILITY)


def body_summary(body: Column, limit: int) -> Column:
    """Length, digest and type of a body, its JSON if that has ``limit`` bytes at most, and how many multipart pieces it
    has; null without a body. ``body`` is a struct of ``byte_length, sha256, content_type, decoded_json, multipart``."""
    small = F.octet_length(body["decoded_json"]) <= limit
    count = F.json_array_length(body["multipart"])
    return F.when(
        body.isNotNull(),
        F.struct(
            body["byte_length"].alias("byte_length"),
            body["sha256"].alias("sha256"),
            body["content_type"].alias("content_type"),
            small.alias("small"),
            F.when(small, body["decoded_json"]).alias("decoded"),
            F.when(body["multipart"].isNotNull(), F.coalesce(count, F.lit(1))).alias("parts"),
        ),
    )


def cut_text(text: Column, most: int) -> Column:
    """A text of ``most`` characters at most; the last one of a longer text is an ellipsis. Characters are never split."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))

"""Texts of records: times, keys, tokens, addresses and trees' first values."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.functions.trees import Number, embedded, root_of


def decimal_seconds(c: Column) -> Column:
    """Seconds as DECIMAL(28,9); null for anything that is no number."""
    return F.trim(c.cast("string")).try_cast("decimal(28,9)")


def time_precision(c: Column) -> Column:
    """seconds, milliseconds, microseconds or nanoseconds, by the digits after the point without trailing zeros."""
    n = F.length(F.regexp_replace(F.regexp_extract(c.cast("string"), r"\.([0-9]*)", 1), "0+$", ""))
    return F.when(c.isNull(), None).when(n == 0, "seconds").when(n <= 3, "milliseconds").when(n <= 6, "microseconds").otherwise("nanoseconds")


def normal_key(c: Column) -> Column:
    """Lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def tokens(c: Column) -> Column:
    """The distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != ""))


def holds_tokens(expected: Column, observed: Column) -> Column:
    """Whether all words of ``expected`` (at least one) are in ``observed``; false if either is null."""
    e = tokens(expected)
    return F.coalesce((F.size(e) > 0) & (F.size(F.array_except(e, tokens(observed))) == 0), F.lit(False))


def pair_key(a: Column, b: Column) -> Column:
    """One key of an unordered pair; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("->", F.least(a, b), F.greatest(a, b)))


def url_path(c: Column) -> Column:
    """The path of an address or of a request target."""
    return F.nullif(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def url_query(c: Column) -> Column:
    """The query as an array of (name, value), repeats kept, values decoded; empty without one."""
    q = F.regexp_extract(F.coalesce(c, F.lit("")), r"\?([^#]*)", 1)
    part = lambda p: F.struct(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("name"), F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)).alias("value"))
    return F.transform(F.filter(F.split(q, "&"), lambda p: p != ""), part)


def first_segment(path: Column) -> Column:
    """The first segment of a path that is not empty."""
    return F.nullif(F.regexp_extract(path, "^/*([^/]+)", 1), F.lit(""))


def after_segment(path: Column, name: str) -> Column:
    """The segment after the last ``name``; null if there is none."""
    return F.nullif(F.regexp_extract(path, f".*/{re.escape(name)}/([^/]*)", 1), F.lit(""))


def header(headers: Column, *names: str) -> Column:
    """The value of the first header with one of the names, case ignored."""
    wanted = [n.lower() for n in names]
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]).isin(wanted)), F.lit(0))["value"]


def status_class(status: Column, response_only: Column) -> Column:
    """success, failure or unknown of an HTTP status."""
    return F.when(F.coalesce(response_only, F.lit(False)), "unknown").when(status.between(200, 399), "success").when(status.between(400, 599), "failure").otherwise("unknown")


def named_code(code: Column, names: dict[str, str], prefix: str) -> Column:
    """The name of a code, ``<prefix>_UNKNOWN_<code>`` for a code without; null for null."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, code), F.concat(F.lit(f"{prefix}_UNKNOWN_"), code))


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


# Causes that mean success.
GOOD_CAUSES = ["normal", "normal_release", "request_accepted", "success", "successful", "0", "1"]
# Words of failures in messages.
BAD_WORDS = ["reject", "fail", "unsuccessful", "error", "not_reachable", "unreachable", "denied", "invalid", "missing"]


def cause_class(message: Column, outcome: Column, cause: Column) -> Column:
    """success, failure or unknown of a signalling message.

    Its words come first: a message that rejects or fails is a failure also
    without a cause, one that accepts or completes a success. Then the outcome
    success, then the cause: one that means success, or any other, a failure;
    without a cause only the outcome failure is one. Nulls count as empty.
    """
    text = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    m, o, c = text(message), text(outcome), F.trim(text(cause))
    return (
        F.when(any_of(m, BAD_WORDS), "failure")
        .when((o == "success") | any_of(m, ["accept", "complete"]), "success")
        .when(c.isin(GOOD_CAUSES), "success")
        .when(~c.isin("", "none") | (o == "failure"), "failure")
        .otherwise("unknown")
    )


def first_values(tree: Column, wanted: dict[str, list[str]], kind: str | None = None) -> Column:
    """Of each field the first scalar, in document order, whose normalised key ends with one of its suffixes.

    One walk over the tree in an Arrow UDF gives a struct of all fields as
    strings. A list of one scalar counts as that scalar; strings that hold trees
    are opened; null, empty and invalid trees give nulls. ``kind`` names a field
    that says whether the root is an object or array, null for neither.
    """
    ends = [(name, tuple(re.sub(r"[\W_]", "", s.lower()) for s in suffixes)) for name, suffixes in wanted.items()]

    def walk(text: str | None) -> dict:
        root = root_of(text)
        found: dict[str, str] = {}
        more = {kind: "object" if type(root) is dict else "array"} if kind and root is not None else {}
        stack = [iter(root.items() if type(root) is dict else [(None, x) for x in root])] if root is not None else []
        while stack and len(found) < len(ends):
            for k, v in stack[-1]:
                t = type(v)
                if t is str:
                    inner = embedded(v)
                    if inner is not None:
                        v, t = inner, type(inner)
                leaf = v[0] if t is list and len(v) == 1 and type(v[0]) not in (dict, list) else v
                if k is not None and type(leaf) not in (dict, list) and leaf is not None:
                    key = re.sub(r"[\W_]", "", k.lower())
                    for name, suffixes in ends:
                        if name not in found and key.endswith(suffixes):
                            found[name] = leaf if isinstance(leaf, (str, Number)) else json.dumps(leaf)
                if t is dict or t is list:
                    stack.append(iter(v.items() if t is dict else [(None, x) for x in v]))
                    break
            else:
                stack.pop()
        return found | more

    names = [*wanted, *([kind] if kind else [])]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [walk(t) for t in texts]
        return pd.DataFrame({name: [None if name not in r else str(r[name]).encode("utf-8", "replace").decode() for r in rows] for name in names}, dtype=object)

    return run(tree.cast("string"))

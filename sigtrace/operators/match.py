"""Matchers and three-valued conditions, compiled to Columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventMatcher:
    """A conjunction; an empty list or null means any. Null and empty identifiers are absent."""

    protocol: str | None = None
    message_types: tuple[str, ...] = ()
    outcomes: tuple[str, ...] = ()
    attribute_equals: dict = field(default_factory=dict)
    identifier_present: tuple[str, ...] = ()

    def column(self) -> Column:
        tests = [F.lit(True)]
        if self.protocol is not None:
            tests.append(F.col("protocol") == self.protocol)
        if self.message_types:
            tests.append(F.col("message_type").isin(*self.message_types))
        if self.outcomes:
            tests.append(F.col("outcome").isin(*self.outcomes))
        tests += [F.col(k).eqNullSafe(F.lit(v)) for k, v in self.attribute_equals.items()]
        tests += [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in self.identifier_present]
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def any_matcher(matchers: list[EventMatcher]) -> Column:
    """Whether any of the matchers fits; no matcher fits nothing."""
    return reduce(lambda a, b: a | b, [m.column() for m in matchers], F.lit(False))


MOST_DEPTH, MOST_NODES = 8, 64


def condition(tree: dict, facts: dict[str, Column]) -> Column:
    """A nullable boolean: ``and``, ``or``, ``not`` are Kleene's, as in SQL.

    ``tree``: {op, children} or {op: present|absent|eq|ne|in, fact, value}. A fact
    that is not in ``facts`` is unknown, so everything about it is null; a known
    fact with a null value is absent, and compares as unknown.
    """
    count = 0

    def build(node: dict, depth: int) -> Column:
        nonlocal count
        count += 1
        if depth > MOST_DEPTH or count > MOST_NODES:
            raise ValueError("condition too deep or too large")
        op = node["op"]
        if op in ("and", "or"):
            parts = [build(c, depth + 1) for c in node["children"]]
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
        if op == "not":
            return ~build(node["children"][0], depth + 1)
        fact = facts.get(node["fact"])
        if fact is None:
            return F.lit(None).cast("boolean")
        if op == "present":
            return fact.isNotNull()
        if op == "absent":
            return fact.isNull()
        if op == "eq":
            return fact == F.lit(node["value"])
        if op == "ne":
            return fact != F.lit(node["value"])
        if op == "in":
            return fact.isin(*node["value"])
        raise ValueError(f"no such op: {op}")

    return build(tree, 1)


def partition_of(protocol: Column, api: Column, lists: dict[str, list[str]]) -> Column:
    """The partition of an event: signalling protocols are primary, an API in a list goes there, else primary."""
    c = F.when(protocol.isin("NAS", "NGAP", "PFCP"), "primary")
    for name, apis in lists.items():
        c = c.when(api.isin(*apis), name)
    return c.otherwise("primary")

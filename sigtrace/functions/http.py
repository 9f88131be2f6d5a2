"""Request targets and bodies of HTTP/2 streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtrace.functions.text import header


def target(headers: Column) -> Column:
    """The address from pseudo-headers: scheme, authority and path as far as they are there; null without a path."""
    path, host, scheme = header(headers, ":path"), header(headers, ":authority", "host"), F.coalesce(header(headers, ":scheme"), F.lit("http"))
    return F.when(path.isNull(), None).when(host.isNull(), path).otherwise(F.concat(scheme, F.lit("://"), host, path))


def boundary(content_type: Column) -> Column:
    """The boundary of a multipart content type, null for any other."""
    return F.nullif(F.regexp_extract(content_type, r'(?i)^\s*multipart/[^;]*;.*?boundary="?([^";]+)"?', 1), F.lit(""))


def parts(body: Column, content_type: Column) -> Column:
    """The parts of a multipart text body as an array of (content_type, content); null if it is none."""
    b = boundary(content_type)
    pieces = F.split(body, F.concat(F.lit(r"(?:^|\r?\n)--\Q"), b, F.lit(r"\E")))
    pieces = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda p: ~p.startswith("--"))
    split = lambda p: F.struct(
        F.nullif(F.trim(F.regexp_extract(p, r"(?im)^content-type:([^\r\n]*)", 1)), F.lit("")).alias("content_type"),
        F.regexp_replace(F.regexp_replace(p, r"(?s)^.*?\r?\n\r?\n", ""), r"\r?\n$", "").alias("content"),
    )
    return F.when(b.isNotNull(), F.transform(pieces, split))


def tree_value(tree: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path of JSON text, null if there is none or it does not fit ``kind``."""
    return F.try_variant_get(F.try_parse_json(tree), "$." + path, kind)

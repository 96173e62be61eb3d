"""Scalars over strings, money, names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(text) -> Column:
    """'$1,024.00' and '-$1.28' as decimals; 0 for anything else."""
    return F.coalesce(F.regexp_replace(_c(text), "[$,\\s]", "").try_cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)"))


def plain_name(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), "\\s+", " "))


def norm_name(text) -> Column:
    """White space collapsed, and the word 'Av' written 'Ave'."""
    return F.regexp_replace(plain_name(text), "\\bAv\\b", "Ave")


def name_matches(text, query: str) -> Column:
    """All words of the query, joined by '+', occur in any case."""
    found = F.lit(True)
    for word in query.lower().split("+"):
        found = found & F.contains(F.lower(_c(text)), F.lit(word))
    return found


def vehicle_id(text) -> Column:
    """'2080.0' and '2080' alike as one number; other identifiers stay."""
    number = _c(text).try_cast("double")
    return F.coalesce(F.when(number == F.floor(number), F.floor(number).cast("string")), _c(text))


def band(value, edges: list[float]) -> Column:
    """Index of the half-open band [edge i, edge i + 1); values outside go to the last band."""
    out = F.lit(len(edges) - 2)
    for i in reversed(range(len(edges) - 1)):
        out = F.when((_c(value) >= edges[i]) & (_c(value) < edges[i + 1]), i).otherwise(out)
    return out


def ride_time(text) -> Column:
    """A timestamp with its zone, in either of two formats; null without a zone."""
    zoned = F.trim(_c(text)).rlike("([+-][0-9]{2}:?[0-9]{2}|Z)$")
    return F.when(zoned, F.coalesce(F.try_to_timestamp(_c(text), F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp(_c(text))))

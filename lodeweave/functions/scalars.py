"""Small expressions of the reports: buckets, percentages, times, guards, envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def growth_colour(g: str) -> Column:
    """P5: red from 0.30, amber from 0.10, else green."""
    return F.when(F.col(g) >= 0.30, "red").when(F.col(g) >= 0.10, "amber").otherwise("green")


def bubble_radius(g: str) -> Column:
    """P5: 40 times the growth and 6, at least 6."""
    return F.greatest(F.lit(6.0), 40 * F.col(g) + 6)


def percent(x: str) -> Column:
    """Hundredths, cut towards zero."""
    return (F.col(x) * 100).cast("int")


def velocity_bar(v: str) -> Column:
    """Share of a velocity of 20, at most 100."""
    return F.least(F.lit(100.0), F.abs(F.col(v)) / 20 * 100)


def iso_timestamp(text: str, default: Column | None = None) -> Column:
    """An ISO text with ``Z`` or an offset; now, or ``default``, where it cannot be read."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(F.col(text), "Z$", "+00:00")), F.current_timestamp() if default is None else default)


def url_allowed(url: str) -> Column:
    """An address over https on the allowed host; null is not allowed."""
    return F.coalesce(F.col(url).startswith("https://") & F.col(url).contains("github.com/"), F.lit(False))


def envelope(data: Column) -> Column:
    """K6: ``data`` as the JSON of a successful response."""
    return F.concat(F.lit('{"success":true,"data":'), F.to_json(data, {"ignoreNullFields": "false"}), F.lit(',"meta":{},"error":null}'))

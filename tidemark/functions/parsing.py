"""Values read out of free text: durations, costs, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes(c: Column) -> Column:
    """Minutes of '90 minutes', '2 hours' or an ISO-8601 duration; null for anything else."""
    n = F.regexp_extract(c, r"([0-9]+)", 1).try_cast("int")
    iso = F.coalesce(F.nullif(F.regexp_extract(c, r"([0-9]+)H", 1), F.lit("")).try_cast("int"), F.lit(0)) * 60 + F.coalesce(
        F.nullif(F.regexp_extract(c, r"([0-9]+)M", 1), F.lit("")).try_cast("int"), F.lit(0)
    )
    return F.when(c.startswith("PT"), iso).when(F.lower(c).contains("hour"), n * 60).when(F.lower(c).contains("min"), n)


def cost_range(c: Column) -> tuple[Column, Column]:
    """Least and most of '$a-b'; a single number is both, no number is 0."""
    low = F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).try_cast("double")
    high = F.nullif(F.regexp_extract(c, "[0-9]+ *- *([0-9]+)", 1), F.lit("")).try_cast("double")
    return F.coalesce(low, F.lit(0.0)), F.coalesce(high, low, F.lit(0.0))


def city_country(c: Column) -> tuple[Column, Column]:
    """First and last of the comma-separated parts; a single part is the city, '' where there is none."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise("")

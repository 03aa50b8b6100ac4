"""URL filters as a temporal list join.

Dated entries (pattern, category, day, action ``add`` or ``remove``) become validity intervals by the next entry of the same pattern
and category; each capture is held against the entries active on its day. A pattern is a host and covers its subdomains, in any case
of its letters. What is asked is each distinct (host, day) once: its host's suffixes meet the intervals of their pattern as of the day,
and the answer meets the captures by (host, day), so that a host with many captures is spread by its days.

The host is what follows the last ``@`` of the authority, without port and final dot, in lower case.

Edge cases: a null or hostless URL matches nothing; a null day is before every entry; several entries of a pattern on one day: the
last by action order counts (``remove`` after ``add``); repeated captures stay; an empty list blocks nothing, no captures give none.
Extra columns stay, but columns named as the results (host, n_active, category, blocked) are replaced by these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column | str) -> Column:
    text = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), AUTHORITY, 1)
    for what in ("^.*@", ":[0-9]*$", r"\.$"):
        text = F.regexp_replace(text, what, "")
    return F.lower(text)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, from, to): ``to`` is exclusive and null while the entry stands."""
    entries = entries.withColumn("pattern", F.lower(F.regexp_replace("pattern", r"\.$", "")))
    one = entries.groupBy("pattern", "category", "day").agg(F.max("action").alias("action"))
    after = F.lead("day").over(Window.partitionBy("pattern", "category").orderBy("day"))
    return one.withColumn("to", after).where("action = 'add'").select("pattern", "category", F.col("day").alias("from"), "to")


def apply_list(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """The captures with host, n_active, category (first in order of the active ones) and blocked."""
    results = ("host", "n_active", "category", "blocked")
    named = captures.withColumns({"__host": host_of(url_col), "__day": F.col(day_col)}).drop(*results)
    asked = named.select("__host", "__day").where("__host <> '' AND __day IS NOT NULL").distinct()
    labels = F.split("__host", r"\.")
    suffixes = asked.withColumn("pattern", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    active = suffixes.join(intervals(entries), "pattern").where((F.col("from") <= F.col("__day")) & (F.col("to").isNull() | (F.col("__day") < F.col("to"))))
    answers = active.groupBy("__host", "__day").agg(F.count("*").alias("n_active"), F.min("category").alias("category"))
    found = named.join(answers, ["__host", "__day"], "left").withColumnRenamed("__host", "host").drop("__day")
    n_active = F.coalesce("n_active", F.lit(0).cast("bigint"))
    return found.withColumns({"n_active": n_active, "blocked": F.col("n_active").isNotNull()})

"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

The points of a golden-ratio sequence fall into the cumulative shares of the sources; each point is a slot of one block of
``BLOCK_WORDS`` words. A source's slots are ranked, slot r takes block r of the source's shuffled documents laid end to end (twice at
most), and the last slot is trimmed so that the source ends at its target. The few slots by which a source's points fall short of its
target are added at the end of the schedule, the few beyond it are dropped. The slot in which a document's words begin is its place in
the mix: rows in the order of their slots have every source at about its share in every stretch.

Edge cases: a null source is a source of its own, last in order; null or empty texts have size 0 and are taken 0 times; repeated ids
are rows of their own; sources without words have target 0; an empty table gives an empty mix. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 1024
#: Rows that one window task sums.
PART_ROWS = 50_000
#: Where a document's words begin in each turn.
SLOTS = ("slot", "slot_again")
_PERIOD, _STEP = 2**31, 1327217885  # an odd step near the period over the golden ratio


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def running_sum(df: DataFrame, key: str, part: str, order: list[str], value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over rows of the key that come earlier by (part, order).

    Parts are summed first and then windows run inside each, so a key with most rows spreads over many tasks.
    """
    sums = df.groupBy(key, part).agg(F.sum(value).alias("__sum"))
    heads = sums.withColumn("__head", F.sum("__sum").over(Window.partitionBy(key).orderBy(part)) - F.col("__sum")).drop("__sum")
    inside = F.sum(value).over(Window.partitionBy(key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return df.withColumn("__inside", inside).join(heads, [key, part]).withColumn("before", F.col("__head") + F.col("__inside")).drop("__head", "__inside")


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, n) of each source to its target, by filling up: sources in order of cap over weight, the first k at cap."""
    ranked = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.col("key").isNull(), "key")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") - 1) % len(WEIGHTS) + 1).cast("double")
    full = Window.partitionBy()
    by_cap = Window.orderBy("ratio", "number").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        ranked.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(full) * SHARE)
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))) / (F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))))
    )
    # The level at which the first uncapped source stands holds for all after it.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number", "level"))).over(full)["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("key", "number", "source_size", "n", "target", "wanted")


def schedule(sources: DataFrame) -> DataFrame:
    """(number, rank, slot): which source's block comes at which place of the mix."""
    spark = sources.sparkSession
    quota = F.ceil(F.round("target") / BLOCK_WORDS).cast("bigint")
    sources = sources.withColumn("quota", quota)
    row = sources.agg(F.sum("quota"), F.count("*")).first()
    n_slots, n_sources = int(row[0] or 0), int(row[1])
    cells = max(1024, 4 * n_sources)
    total = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(Window.orderBy("number"))
    bounds = sources.where("target > 0").withColumn("high", upto / total).withColumn("low", (upto - F.col("target")) / total)
    bounds = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    point = F.pmod(F.pmod(F.col("id"), F.lit(_PERIOD)) * _STEP, F.lit(_PERIOD)) / float(_PERIOD)
    points = spark.range(n_slots).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells))
    placed = points.join(bounds.select("cell", "low", "high", "number", "quota"), "cell").where("point >= low AND point < high")
    placed = placed.select("number", "quota", F.col("id").alias("slot"), F.lit(1).cast("bigint").alias("one")).withColumn("part", F.floor(F.col("slot") / (4 * PART_ROWS)))
    ranked = keep(running_sum(placed, "number", "part", ["slot"], "one").select("number", "quota", "slot", F.col("before").alias("rank")).where("rank < quota"), "slots")
    filled = ranked.groupBy("number").agg(F.count("*").alias("filled"))
    short = sources.join(filled, "number", "left").withColumn("filled", F.coalesce("filled", F.lit(0))).where("filled < quota")
    added = short.select("number", F.explode(F.sequence("filled", F.col("quota") - 1)).alias("rank")).withColumn("slot", F.lit(n_slots) + F.col("rank"))
    return ranked.select("number", "rank", "slot").union(added)


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target (of its source), taken (words that the mix takes of it), slot, slot_again.

    The last two are the slots in which its words begin the first and the second time; null where it is not taken so often.
    """
    shuffled = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    sized = keep(documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("key"), word_count(text_col).alias("size"), shuffled.alias("draw")), "sizes")
    sources = keep(targets(sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))), "sources")
    rows = sized.join(sources, sized["key"].eqNullSafe(sources["key"])).drop("key", "wanted")
    place = F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("part", F.floor(place * F.ceil(F.col("n") / PART_ROWS) / float(2**32)))
    laid = running_sum(rows, "number", "part", ["draw", "id", "size"], "size")
    passes = laid.withColumn("turn", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(MOST)))))
    passes = passes.withColumn("low", F.col("before") + F.col("turn") * F.col("source_size")).withColumn("high", F.col("low") + F.col("size"))
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / BLOCK_WORDS), F.floor(F.greatest(F.col("low"), F.col("high") - 1) / BLOCK_WORDS))))
    slots = schedule(sources)
    start = F.col("rank") * BLOCK_WORDS
    stop = F.least(start + BLOCK_WORDS, F.round("target").cast("bigint"))
    words = F.when(F.col("slot").isNotNull(), F.greatest(F.lit(0), F.least("high", stop) - F.greatest("low", start))).otherwise(0)
    joined = pieces.join(slots, ["number", "rank"], "left")
    return _per_row(joined, words, id_col)


def _per_row(joined: DataFrame, words: Column, id_col: str) -> DataFrame:
    """Sums the pieces of each row; rows of size 0 lie at one place, so equal ones are counted by their first pieces."""
    first = F.when((F.col("turn") == 0) & (F.col("rank") == F.floor(F.col("low") / BLOCK_WORDS)), 1)
    begins = [F.min(F.when((F.col("turn") == i) & (words > 0), F.col("slot"))).alias(name) for i, name in enumerate(SLOTS)]
    summed = joined.groupBy("id", "number", "before", "size", "source_size", "target").agg(F.sum(words).cast("bigint").alias("taken"), F.count(first).alias("rows"), *begins)
    rows = summed.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", *SLOTS)


def take(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slot_col: str | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, to whole documents (of a source at most one is cut, and rounded).

    With ``slot_col`` each copy carries its slot in a column of that name, in place of one that the documents have; who reads the rows
    in that order reads the sources interleaved by their shares.
    """
    place = "__at"
    rows = keep(documents.withColumn(place, F.monotonically_increasing_id()), "rows")
    copies = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    begins = F.slice(F.array(*SLOTS), F.lit(1), copies)
    taken = mix(rows, place, text_col, source_col).where(copies > 0).select(place, begins.alias("__slots"))
    every = rows.join(taken, place).withColumn("__slot", F.explode("__slots"))
    if slot_col is None:
        return every.select(documents.columns)
    others = [c for c in documents.columns if c.lower() != slot_col.lower()]
    return every.select(*others, F.col("__slot").alias(slot_col))

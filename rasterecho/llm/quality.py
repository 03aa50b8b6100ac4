"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is built-in column expressions. Long intermediate arrays are made once by one-row generators, which keep the optimizer from
copying them into every place that reads them.

Edge cases: null or empty text has no words, all measures 0 and fails the base rule; repeated rows are judged each for itself; very
long texts stay in one row (windows are compared by 64-bit hashes, sorted only where a hash occurs twice). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RUN = 8
LEAST_WORDS, MOST_REPEATED = 20, 30

#: Common words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for was on with as be by this are or from an at not have has had but you we they he she his her "
    "de la le les et des en un une du que qui dans pour pas sur au avec par ce il elle est sont ne se plus "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "el los las y que del se con una su para es al lo como más o pero sus le ha me si sin sobre este ya entre"
).split()

#: measure, least, most (None: no bound).
RULES = (
    ("mean_word_length", 2.0, 18.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.01, None),
    ("duplicate_line_ratio", None, 0.5),
)


def _once(df: DataFrame, name: str, value: Column, *drop: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(value))).drop(*drop)


def measures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.lit(0)
    for s in SYMBOLS:
        symbols = symbols + (F.octet_length("text") - F.octet_length(F.replace("text", F.lit(s), F.lit(""))))
    rows = documents.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = _once(rows, "words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = _once(rows, "lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "id", "words", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    stop = F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint")
    windows = F.when(F.size("words") >= RUN, F.transform(F.sequence(F.lit(1), F.size("words") - (RUN - 1)), lambda i: F.xxhash64(F.slice("words", i, RUN)))).otherwise(F.array().cast("array<bigint>"))
    rows = _once(rows.withColumn("n_stop_words", stop), "hashes", windows, "words")
    twice = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("p")))))
    rows = _once(rows, "sorted", F.coalesce(twice, F.array().cast("array<struct<h: bigint, p: bigint>>")), "hashes")
    none = F.array(F.lit(None).cast("bigint"))
    around = F.arrays_zip(F.col("sorted.p").alias("p"), F.col("sorted.h").alias("h"), F.concat(none, F.slice("sorted.h", 1, F.greatest(F.size("sorted") - 1, F.lit(0)))).alias("b"), F.concat(F.slice("sorted.h", 2, F.size("sorted")), none).alias("a"))
    rows = _once(rows, "repeats", F.sort_array(F.transform(F.filter(F.slice(around, 1, F.size("sorted")), lambda x: (x["h"] == x["b"]) | (x["h"] == x["a"])), lambda x: x["p"])), "sorted")
    covered = F.aggregate(
        "repeats", F.struct(F.lit(-RUN).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(RUN).cast("bigint"), p - s["last"])).alias("n")), lambda s: s["n"],
    )
    return rows.withColumn("n_repeat_words", covered).drop("repeats").withColumnRenamed("id", id_col)


def judge(documents: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures with base_failed, failed (names of broken rules) and kept."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    value = {
        "mean_word_length": F.col("word_chars") / n, "symbol_ratio": F.col("n_symbols") / n, "stop_word_ratio": F.col("n_stop_words") / n,
        "duplicate_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
    }
    broken = [F.when((value[name] < low if low is not None else F.lit(False)) | (value[name] > high if high is not None else F.lit(False)), name) for name, low, high in rules]
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = measures(documents, id_col, text_col).withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*broken)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))

"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Shingles are ``SHINGLE`` words, lower-cased, with signs at the ends removed. A window holds ``WINDOW`` words and starts every
``STRIDE`` words, so a template of at most ``WINDOW - STRIDE`` words lies whole in some window. Longer templates are cut in pieces of
that many words, spread evenly so that none is shorter. Bands of one row: a window that contains a piece shares a coordinate with it
with the piece's part of the window's shingles; ``BANDS`` coordinates leave under 1e-4 of them unmet for pieces of ``FEW`` shingles or
more. Templates of fewer are met by their shingles themselves, without loss. Texts that share no shingle with any template cannot
contain one and need no windows. Column expressions only.

Pieces only retrieve. What is reported is the part of the whole template's shingles that stands in the span of the text around the
window in which the template would lie if its piece is there, a quarter longer on each side of the piece; at one piece the span is the window.

Edge cases: null or empty text, or one shorter than a shingle, has no match; a license found in several windows is one row with its
best containment and the number of retrieved windows around which it stands; equal rows give equal rows; an empty template table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import keep

SHINGLE, WINDOW, STRIDE, BANDS = 3, 16, 4, 28
FEW = 4
LEAST = 0.8

#: Notices looked for (fixed values).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def _words(text: str) -> Column:
    clean = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.lower(F.regexp_replace(w, r"^[\p{Punct}]+|[\p{Punct}]+$", "")))
    return F.filter(clean, lambda w: w != "")


def _shingles(words: str) -> Column:
    n = F.size(words) - (SHINGLE - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))


def _once(df: DataFrame, name: str, value: Column, *drop: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(value))).drop(*drop)


def _coordinates(shingles: str) -> Column:
    """One minimum per band under rehashing with the band's number, made into a key with that number."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.xxhash64(k, F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k)))))


def scan(documents: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, n_windows) for each license that a text contains to at least ``LEAST``."""
    held = WINDOW - STRIDE - (SHINGLE - 1)  # shingles of a piece
    known = _once(_once(templates.select("license", "text"), "words", _words("text"), "text"), "shingles", _shingles("words"), "words").where(F.size("shingles") > 0)
    known = known.withColumn("template", F.xxhash64("license", "shingles")).dropDuplicates(["license", "template"])
    n = F.size("shingles")
    parts = F.ceil(n / held)
    offsets = F.transform(F.sequence(F.lit(1), parts), lambda k: F.floor((k - 1) * (n - held) / F.greatest(parts - 1, F.lit(1))).cast("int"))
    pieces = known.select("template", "shingles", n.alias("n"), F.explode(offsets).alias("offset")).withColumn("piece", F.slice("shingles", F.col("offset") + 1, held))
    own = lambda shingles: F.transform(shingles, lambda h: F.xxhash64(F.lit(0), h))
    met_by = F.concat(_coordinates("piece"), F.when(F.col("n") < FEW, own("piece")).otherwise(F.array().cast("array<bigint>")))
    pieces = pieces.select("template", "offset", "n", F.explode(F.array_distinct(met_by)).alias("key"))
    every = known.select(n.alias("n"), F.explode("shingles").alias("h"))
    vocabulary = F.broadcast(every.agg(F.collect_set("h").alias("vocabulary"), F.collect_set(F.when(F.col("n") < FEW, F.col("h"))).alias("short")))  # as small as the templates
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = _once(_once(rows, "words", _words("text"), "text"), "shingles", _shingles("words"), "words")
    rows = rows.withColumn("one", F.lit(1)).join(vocabulary.withColumn("one", F.lit(1)), "one").where(F.arrays_overlap("shingles", "vocabulary")).drop("vocabulary", "one")
    rows = keep(rows.withColumn("same", F.xxhash64("shingles")), "licensed")
    starts = F.sequence(F.lit(1), F.size("shingles"), F.lit(STRIDE))
    windows = rows.select("id", "same", "short", F.posexplode(F.transform(starts, lambda i: F.slice("shingles", i, WINDOW - SHINGLE + 1))).alias("at", "window"))
    keyed = windows.select("id", "same", "at", F.explode(F.concat(_coordinates("window"), own(F.array_intersect("window", "short")))).alias("key"))
    # The span: what lies before the piece and behind it in the template, and a quarter more, around the window.
    begin = F.greatest(F.lit(1), F.col("at") * STRIDE + 1 - F.floor(F.col("offset") * 1.25)).cast("int")
    end = (F.col("at") * STRIDE + WINDOW - SHINGLE + 2 + F.floor(F.greatest(F.col("n") - F.col("offset") - held, F.lit(0)) * 1.25)).cast("int")
    hits = keyed.join(pieces, "key").select(F.col("id").alias("hit_id"), F.col("same").alias("hit_same"), "template", F.struct("at", begin.alias("begin"), (end - begin).alias("size")).alias("span"))
    hits = hits.groupBy("hit_id", "hit_same", "template").agg(F.collect_set("span").alias("spans"))
    met = hits.join(rows.dropDuplicates(["id", "same"]).select("id", "same", F.col("shingles").alias("text")), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("same") == F.col("hit_same")))
    met = _once(met.join(F.broadcast(known), "template"), "wanted", F.array_distinct("shingles"), "shingles")
    share = lambda s: F.size(F.array_intersect("wanted", F.slice("text", s["begin"], s["size"]))) / F.size("wanted")
    shares = met.select("id", "license", F.explode(F.transform("spans", lambda s: F.struct(s["at"].alias("at"), share(s).alias("share")))).alias("of"))
    found = shares.where(F.col("of.share") >= LEAST).groupBy("id", "license").agg(F.max("of.share").alias("containment"), F.countDistinct("of.at").alias("n_windows"))
    return found.withColumnRenamed("id", id_col)

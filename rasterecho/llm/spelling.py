"""Spelling variants: words one edit apart, found by blocked products of letter counts.

A word is a vector of letter counts. An inserted or deleted letter moves it by a squared distance of 1, a replaced one by 2, so near
words lie at most 2 apart, and one NumPy product of two blocks of vectors gives the squared distances of all their pairs; what is close
is then verified letter by letter.

Blocks: words of equal length whose letters fall alike into ``GROUPS`` groups of the alphabet (a length for each group). One edit moves
at most one letter out of a group and one into a group, so a block meets itself and the few blocks beside it, in its own length and the
next, and no near pair is lost. A block is cut into chunks of bounded size, and pairs of chunks are the rows that are worked on: no row
for a pair of words is made before it is verified.

Edge cases: null or empty text: no words. Runs count once per occurrence; repeated rows count again. A null id draws like an empty one.
No words make an empty table. Ties of form go to the first word in code point order. Extra columns are ignored, whatever their names.
A very long run is a word like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep
from .textbytes import LOWER, NON_SPACE, slabs, word_bounds, word_hashes

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One of so many (document, word) pairs is misspelled, by the pair's own checksum.
MISSPELLED = 97
GROUPS = 6
#: Words and letters of a chunk, and about how many words meet a chunk in one row: bounds of a task's memory.
CHUNK_WORDS, CHUNK_LETTERS, ROW_WORDS = 512, 16_384, 2_048
SQUARED, COLUMNS = 2, 32
#: Length from which a checksum is taken of the bytes themselves, not put together from two.
LONG = 48
#: Letters by how common they are, dealt to the groups in turn so that groups are about equal.
_FOLD = "etaoinshrdlcumwfgypbvkjxqz"

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def _checksums(heads: list[bytes], owner: np.ndarray, words: list[bytes], which: np.ndarray) -> np.ndarray:
    """CRC-32 of head + word for each (owner, which). A checksum is linear: that of the head is moved on by the word's length."""
    lengths = np.array([len(w) for w in words], np.int64)
    tails = np.array([zlib.crc32(w) for w in words], np.uint32)
    moved = np.zeros((LONG, len(heads)), np.uint32)
    moved[0] = [zlib.crc32(h) for h in heads]
    for n in range(1, LONG):
        moved[n] = moved[n - 1] >> np.uint32(8) ^ _CRC[moved[n - 1] & np.uint32(255)]
    size = lengths[which]
    out = moved[np.minimum(size, LONG - 1), owner] ^ tails[which]
    for i in np.flatnonzero(size >= LONG):
        out[i] = zlib.crc32(heads[owner[i]] + words[which[i]])
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each slab of texts, some misspelled; words of fewer letters than are wanted are left out."""
    for batch in batches:
        ids = ["" if i is None else str(i) for i in batch.column(0).to_pylist()]
        for row, end, data, offsets in slabs(batch.column(1)):
            letter = (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122)
            lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
            letter |= lead
            letter[1:] |= lead[:-1]
            folded = np.where(letter, LOWER[data], np.uint8(32))
            starts, ends, first = word_bounds(folded, offsets, NON_SPACE)
            if not len(starts):
                continue
            _, at, which = np.unique(word_hashes(folded, starts, ends, NON_SPACE), return_index=True, return_inverse=True)
            raw = folded.tobytes()
            words = [raw[a:z] for a, z in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            owner = np.repeat(np.arange(end - row), np.diff(first))
            sums = _checksums([f"{i}:".encode() for i in ids[row:end]], owner, words, which)
            wrong = sums % np.uint32(MISSPELLED) == 0
            n = np.bincount(which[~wrong], minlength=len(words)).tolist()
            found = {w.decode(): c for w, c in zip(words, n, strict=True) if c}
            for i in np.flatnonzero(wrong).tolist():
                word = words[which[i]].decode()
                k = int(sums[i]) % len(word)
                word = word[:k] + word[k + 1 :]
                found[word] = found.get(word, 0) + 1
            found = {w: c for w, c in found.items() if len(w) >= LEAST_LETTERS}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


def vocabulary(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``LEAST_LETTERS`` letters seen at least ``LEAST_COUNT`` times; slabs count before the shuffle."""
    counts = documents.select(id_col, text_col).mapInArrow(_counted, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


_GROUP = np.arange(256) % GROUPS
_COLUMN = 26 + np.arange(256) % (COLUMNS - 26)
for _i, _c in enumerate(_FOLD):
    _GROUP[ord(_c)], _COLUMN[ord(_c)] = _i % GROUPS, _i


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, cell): how many of the word's letters each group has."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        counts = np.bincount(owner * GROUPS + _GROUP[letters & 255], minlength=len(words) * GROUPS).astype(np.int32)
        cells = pa.ListArray.from_arrays(np.arange(0, len(counts) + 1, GROUPS, np.int32), pa.array(counts))
        yield pa.RecordBatch.from_arrays([batch.column(0), cells], ["word", "cell"])


def _one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    most = min(len(a), len(b))
    i = next((k for k in range(most) if a[k] != b[k]), most)
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _vectors(words: list[str]) -> np.ndarray:
    """Letter counts. Letters but a-z share columns, which can only bring words closer, never move near words apart."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(owner * COLUMNS + _COLUMN[letters & 255], minlength=len(words) * COLUMNS).reshape(-1, COLUMNS).astype(np.float64)


def close_pairs(left: list[str], right: list[str]) -> set[tuple[str, str]]:
    """Pairs of the two lists at a squared distance of at most 2 that are one edit apart, each in order."""
    x, y = _vectors(left), _vectors(right)
    kind = np.float32 if max(map(len, left + right), default=0) < 2000 else np.float64  # exact in either
    # The norms are two more columns, so that the product itself gives the distances.
    x = np.column_stack([-2 * x, (x**2).sum(axis=1), np.ones(len(x))]).astype(kind)
    y = np.column_stack([y, np.ones(len(y)), (y**2).sum(axis=1)]).astype(kind)
    at = np.flatnonzero(x @ y.T <= SQUARED)
    i, j = at // len(right), at % len(right)
    return {(min(a, b), max(a, b)) for a, b in ((left[p], right[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)) if _one_edit(a, b)}


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[str, str]] = []
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            found += close_pairs(left.as_py(), right.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.string()) for k in (0, 1)], ["a", "b"])


def _steps() -> list[list[int]]:
    """Where one edit leads from a cell, each pair of cells once: nowhere, a letter more in a group, or one moved to another group."""
    unit = np.eye(GROUPS, dtype=int)
    moved = [unit[i] - unit[j] for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    return [v.tolist() for v in (0 * unit[0], *unit, *moved)]


def near_words(words: DataFrame, word_col: str = "word") -> DataFrame:
    """(a, b): each pair of distinct words one edit apart once. ``words`` holds each word once."""
    celled = keep(words.select(F.col(word_col).alias("word")).mapInArrow(_celled, "word string, cell array<int>"), "cells")
    parts = F.greatest(F.ceil(F.count("*") / CHUNK_WORDS), F.ceil(F.sum(F.length("word")) / CHUNK_LETTERS)).cast("int")
    sizes = keep(celled.groupBy("cell").agg(F.count("*").alias("n"), parts.alias("parts")), "cell-sizes")
    part = F.pmod(F.xxhash64("word"), "parts").cast("int")
    chunks = keep(celled.join(sizes, "cell").groupBy("cell", part.alias("part")).agg(F.collect_list("word").alias("words")), "chunks")
    steps = F.array(*[F.array(*map(F.lit, v)) for v in _steps()])
    meets = sizes.select("cell", "parts", F.explode(F.transform(steps, lambda v: F.zip_with("cell", v, lambda a, b: a + b))).alias("other"))
    meets = meets.join(sizes.withColumnsRenamed({"cell": "other", "n": "other_n", "parts": "other_parts"}), "other")
    # A cell meets at most as many others as there are steps, so this window is small.
    slices = F.ceil(F.sum("other_n").over(Window.partitionBy("cell")) / ROW_WORDS)
    pairs = meets.select("cell", "other", slices.alias("slices"), "other_parts", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    pairs = pairs.select("cell", "other", "slices", "part", F.explode(F.expr("sequence(0, other_parts - 1)")).alias("other_part"))
    pairs = pairs.where("cell != other OR part <= other_part").withColumn("slice", F.pmod(F.xxhash64("other", "other_part"), "slices"))
    # The rows are few and their work is not: they are dealt to all tasks, whatever their bytes.
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.join(chunks.withColumnsRenamed({"cell": "other", "part": "other_part"}), ["other", "other_part"]).repartition(n, "cell", "part")
    met = met.groupBy("cell", "part", "slice").agg(F.flatten(F.collect_list("words")).alias("right"))
    left = chunks.withColumnRenamed("words", "left").repartition(n, "cell", "part")
    return met.join(left, ["cell", "part"]).select("left", "right").mapInArrow(_edges, "a string, b string")


def variants(words: DataFrame) -> DataFrame:
    """Per row (word, n): word, form (its near word of largest n, if that is at least twice its own), root, n, n_near, form_n.

    Forms at least double the count, so chains are short; roots are found by doubling steps.
    """
    words = keep(words.select("word", "n"), "words")
    edges = keep(near_words(words), "near")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.join(words.withColumnsRenamed({"word": "b", "n": "b_n"}), "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("down"), F.col("b").alias("word"))).alias("best")
    )
    found = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    taken = -F.col("best.down") >= 2 * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.down")).alias("form_n"),
    )
    found = keep(found, "forms")
    steps = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = keep(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

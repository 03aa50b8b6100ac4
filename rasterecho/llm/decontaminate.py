"""Benchmark decontamination with an FM-index over each shard of training words.

A shard is a run of whole documents. Its words become symbols of the benchmark's vocabulary; words outside it can match nothing and
part the text, as do ends of documents. The suffix array of the symbols gives the Burrows-Wheeler transform, kept as a wavelet
matrix; all phrases are searched backwards at once, and occurrences are located by walking to the next sampled suffix.
Overlapping occurrences merge into removal spans.

Edge cases: null, empty or wordless texts have no words and no hits; an item without words is no phrase; an item shorter than the
window is one phrase; repeated items count each by its own id; an item with a null id never counts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep
from .textbytes import ALNUM, LOWER, slabs, word_bounds, word_hashes

WINDOW = 10
SAMPLE = 16
#: Bytes of benchmark text that one pass over the documents searches for; a larger benchmark takes several passes.
BLOCK_BYTES = 24_000_000


class WaveletMatrix:
    """Counts of a symbol before a place, by one bit vector with running counts for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.ranks, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b & 1).astype(bool)
            self.ranks.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(ones, dtype=np.int32)]))
            self.zeros.append(len(symbols) - int(self.ranks[-1][-1]))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for b, ranks, zeros in zip(range(self.bits - 1, -1, -1), self.ranks, self.zeros, strict=True):
            one = (symbol >> b & 1).astype(bool)
            place = np.where(one, zeros + ranks[place], place - ranks[place])
            start = np.where(one, zeros + ranks[start], start - ranks[start])
        return place - start


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes in order; every 0 parts the text and is smaller than any 0 after it. By doubling of the compared length."""
    n = len(symbols)
    place_bits = max(1, n.bit_length())
    take = max(1, (63 - place_bits) // bits)
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(take, np.int64)])
    for i in range(take):
        s = np.where(live, padded[i : i + n], 0)
        live = s > 0
        key = key << bits | s
    packed = np.sort(key << place_bits | np.arange(n))
    order = packed & ((1 << place_bits) - 1)
    packed >>= place_bits
    ended = (packed & ((1 << bits) - 1)) == 0  # with a 0 among the compared symbols the place decides, as it did
    fresh = np.ones(n, bool)
    fresh[1:] = (packed[1:] != packed[:-1]) | ended[1:]
    length = take
    while True:
        heads = np.flatnonzero(fresh)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        rows = order[at]
        after = rank[np.minimum(rows + length, n - 1)]
        by = np.lexsort((after, rank[rows]))
        order[at] = rows[by]
        first, second = rank[rows][by], after[by]
        fresh[at] = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        length *= 2


class FMIndex:
    """Over symbols of which 0 parts texts; answers where phrases without 0 occur."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        order = suffix_array(symbols, self.bits)
        last = symbols[order - 1]  # order 0 wraps to the text's last symbol, which is 0
        self.tree = WaveletMatrix(last, self.bits)
        self.last = last
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 2))])
        # Starts of runs are sampled, for the walk cannot pass a 0.
        self.sampled = (order % SAMPLE == 0) | (last == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned phrases (one a row)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        alive = np.arange(len(phrases))
        for i in range(1, phrases.shape[1] + 1 if len(phrases) else 1):
            alive = alive[low[alive] < high[alive]]
            now = alive[lengths[alive] >= i]
            if not len(now):
                break
            s = phrases[now, -i]
            low[now] = self.first[s] + self.tree.rank(s, low[now])
            high[now] = self.first[s] + self.tree.rank(s, high[now])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            s = self.last[rows[open_]]
            rows[open_] = self.first[s] + self.tree.rank(s, rows[open_])
            walked[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.samples[self.sample_rank[rows]] + walked


class Phrases:
    """Distinct windows of a block of benchmark items, and whose they are."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), ALNUM)
            words = [vocabulary.setdefault(raw[s:e].tobytes(), len(vocabulary) + 1) for s, e in zip(starts, ends, strict=True)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.words = list(vocabulary)
        raw = np.frombuffer(b" ".join(self.words), np.uint8)
        starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), ALNUM)
        hashes = word_hashes(raw, starts, ends, ALNUM)
        by = np.argsort(hashes)
        self.hashes, self.symbols = hashes[by], by.astype(np.int32) + 1
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.table = np.zeros((len(owners), window), np.int32)
        for i, p in enumerate(owners):
            self.table[i, window - len(p) :] = p
        self.owners = [sorted(o) for o in owners.values()]

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.symbols[at], 0).astype(np.int32)


def _occurrences(phrases: Phrases, data, starts, ends, first) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence in a shard."""
    symbols = phrases.symbols_of(word_hashes(data, starts, ends, ALNUM))
    # A place stays if it lies in a run of known words that is as long as the shortest phrase; a 0 stands for all between two runs.
    cut = np.zeros(len(symbols) + 1, bool)
    cut[first] = True
    known = symbols > 0
    opens = known & (cut[:-1] | ~np.concatenate([[False], known[:-1]]))
    closes = known & (cut[1:] | ~np.concatenate([known[1:], [False]]))
    a, z = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = z - a >= phrases.lengths.min()
    a, z = a[long], z[long]
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = z - a
    begin = np.cumsum(sizes + 1) - sizes  # one 0 before each run, one at the end
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text = np.zeros(int(sizes.sum()) + len(a) + 1, np.int32)
    word = np.zeros(len(text), np.int64)
    target = np.repeat(begin, sizes) + place
    word[target] = np.repeat(a, sizes) + place
    text[target] = symbols[word[target]]
    index = FMIndex(text, len(phrases.words))
    low, high = index.search(phrases.table, phrases.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(low, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return which, word[index.locate(rows)]


def _same_words(phrases: Phrases, low: np.ndarray, starts, ends, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact check of located phrases, byte by byte, once for each distinct (phrase, place)."""
    good = np.ones(len(which), bool)
    for i, (p, w) in enumerate(zip(which, at, strict=True)):
        n = int(phrases.lengths[p])
        want = b" ".join(phrases.words[s - 1] for s in phrases.table[p, -n:])
        got = b" ".join(low[starts[w + j] : ends[w + j]].tobytes() for j in range(n))
        good[i] = want == got
    return good


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, spans, items = [], [], []
        for row, end, data, offsets in slabs(batch.column(1)):
            starts, ends, first = word_bounds(data, offsets, ALNUM)
            which, at = _occurrences(phrases, data, starts, ends, first) if len(phrases.lengths) else (np.zeros(0, int),) * 2
            good = _same_words(phrases, LOWER[data] if len(at) else data, starts, ends, which, at)
            which, at = which[good], at[good]
            doc = np.searchsorted(first, at, "right") - 1
            by = np.lexsort((at, doc))
            which, at, doc = which[by], at[by], doc[by]
            parts = np.searchsorted(doc, np.arange(end - row + 1))
            counts += np.diff(first).tolist()
            for i in range(end - row):
                own = slice(parts[i], parts[i + 1])
                found: list[list[int]] = []
                for w, size in zip((at[own] - first[i]).tolist(), phrases.lengths[which[own]].tolist(), strict=True):
                    if found and w <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], w + size)
                    else:
                        found.append([w, w + size])
                spans.append([{"first": x, "end": y} for x, y in found])
                items.append(sorted({o for p in np.unique(which[own]) for o in phrases.owners[p]}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for item, text in benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        block.append((item, text or ""))
        size += len(text or "") + 1
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_benchmark(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, spans (merged word ranges to remove), items (ids whose windows occur), both in order.

    One pass over the documents for each ``BLOCK_BYTES`` of benchmark; several passes meet by row.
    """
    sc = documents.sparkSession.sparkContext
    kind = f"id {documents.schema[id_col].dataType.simpleString()}, n_words bigint, spans array<struct<first: bigint, end: bigint>>, items array<string>"

    def one(source: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
        sent = sc.broadcast(Phrases(block, window))
        return source.mapInArrow(lambda batches: _search(batches, sent.value), kind)

    source, blocks = documents.select(id_col, text_col), _blocks(benchmark, item_col, item_text)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return one(source, first).withColumnRenamed("id", id_col)
    # Rows need a key that survives several passes, as ids may repeat.
    keyed = keep(documents.select(F.struct(F.col(id_col), F.monotonically_increasing_id().alias("row")).alias("key"), text_col), "keyed")
    kind = kind.replace(kind.split(",", 1)[0], f"id {keyed.schema['key'].dataType.simpleString()}", 1)
    every = None
    for block in (first, second, *blocks):
        found = keep(one(keyed, block), "block")
        every = found if every is None else every.union(found)
    merged = every.groupBy("id").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        "spans", F.expr("CAST(array() AS array<struct<first: bigint, end: bigint>>)"),
        lambda done, s: F.when((F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    return merged.select(F.col("id")[id_col].alias(id_col), "n_words", joined.alias("spans"), "items")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_benchmark``'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        *[c for c in found.columns if c not in ("spans", "items")], hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the documents in which a window of the benchmark occurs. The search runs beside the other columns."""
    place = "__at"
    rows = keep(documents.withColumn(place, F.monotonically_increasing_id()), "rows")
    # Written first: Spark then knows the size, and where it is small no row of the documents is shuffled.
    bad = keep(find_benchmark(rows, benchmark, window, place, text_col).where(F.size("spans") > 0).select(place), "contaminated")
    return rows.join(bad, place, "left_anti").select(documents.columns)

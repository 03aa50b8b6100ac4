"""Fill-in-middle transformation: two cuts of each text, found by rank and select on a wavelet matrix over character classes.

The bytes of many whole texts become one string of eight classes: line end, other white space, inner byte of a code point, any other,
each with a bit that says whether white space (or a text's start) came before. The wavelet matrix keeps one bit vector for each of the
three class bits, stably sorted from level to level, with a rank directory. A token ends where white space follows something else, so
the tokens before a place are the sum of two class ranks; inner bytes, ranked alike, turn bytes into code points. The k-th end is found
by bisection on those ranks, for all texts of a slab at once.

Edge cases: null text counts as empty; empty: no token, ``plain``. A text of white space alone is one token. Texts that hold one of the
signs ``<P>``, ``<S>``, ``<M>`` stay plain. Repeated rows are transformed alike; a null id draws like an empty one. Extra columns are
ignored, whatever their names. A very long text is a slab of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import slabs

#: Signs of the three parts, and shares in percent: texts that are transformed, and of those the ones in suffix-prefix-middle order.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SPM = 50, 80
SEED = 42
SLAB_BYTES = 1_000_000
BITS, BLOCK = 3, 512
LINE_END, SPACE, INNER, OTHER, AFTER_SPACE = 0, 1, 2, 3, 4
#: The classes at which a token has ended just before: white space after something else.
ENDS = (LINE_END, SPACE)

_KIND = np.full(256, OTHER, np.uint8)
_KIND[[32, 9, 11, 12, 13]] = SPACE
_KIND[10] = LINE_END
_KIND[128:192] = INNER
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of each byte; the start of a text counts as white space."""
    kind = _KIND[data]
    after = np.empty(len(kind), bool)
    after[1:] = kind[:-1] <= SPACE
    after[offsets[:-1][offsets[:-1] < len(kind)]] = True
    return kind | (after * np.uint8(AFTER_SPACE))


class Bits:
    """A bit vector with the number of ones before each block of ``BLOCK`` bits."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        room = -(-(self.size + 1) // BLOCK) * (BLOCK // 8)
        self.packed = np.zeros(room, np.uint8)
        self.packed[: len(packed)] = packed
        words = np.bitwise_count(self.packed.view(np.uint64)).reshape(-1, BLOCK // 64).astype(np.int64)
        self.words = np.cumsum(words, axis=1) - words
        self.before = np.concatenate([[0], np.cumsum(words.sum(axis=1))])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place: the block's count, the words before within the block, and the bits before within the word."""
        word = at >> 6
        part = self.packed.view(np.uint64)[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at // BLOCK] + self.words[at // BLOCK, word % (BLOCK // 64)] + np.bitwise_count(part)


class WaveletMatrix:
    """Rank of any class before any place of a string of small numbers."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS) -> None:
        self.levels = []
        for level in reversed(range(bits)):
            ones = (symbols >> level & 1).astype(bool)
            self.levels.append((level, Bits(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(at), at
        for level, bits in self.levels:
            low_ones, high_ones = bits.rank(low), bits.rank(high)
            if symbol >> level & 1:
                zeros = bits.size - bits.ones
                low, high = zeros + low_ones, zeros + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return high - low


class Cuts:
    """Token counts and token ends of the texts of one slab."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.matrix = WaveletMatrix(classes(data, offsets))
        self.start, self.stop = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        self.first = self.ends(self.start)
        # The last token ends with its text, where no white space follows.
        self.counts = self.ends(self.stop) - self.first + (self.stop > self.start)

    def ends(self, at: np.ndarray) -> np.ndarray:
        """Token ends marked before each place."""
        return sum(self.matrix.rank(c, at) for c in ENDS)

    def code_points(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        inner = lambda at: self.matrix.rank(INNER, at) + self.matrix.rank(INNER | AFTER_SPACE, at)
        return high - low - (inner(high) - inner(low))

    def place(self, units: np.ndarray) -> np.ndarray:
        """Byte at which the first ``units`` tokens of each text end: the least place with that many marks before the byte after it."""
        low, high = self.start.copy(), self.stop.copy()
        wanted = self.first + units
        inside = (units > 0) & (units < self.counts)
        high[units <= 0] = self.start[units <= 0]
        low[units >= self.counts] = self.stop[units >= self.counts]
        while (going := np.flatnonzero(inside & (low < high))).size:
            middle = (low[going] + high[going]) // 2
            enough = self.ends(middle + 1) >= wanted[going]
            high[going[enough]] = middle[enough]
            low[going[~enough]] = middle[~enough] + 1
        return np.where(units <= 0, self.start, low)


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signs = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
    for batch in batches:
        h = [np.asarray(batch.column(i)) for i in range(2, 6)]
        for row, end, data, offsets in slabs(batch.column(1), SLAB_BYTES):
            cuts = Cuts(data, offsets)
            one, two, three, four = (x[row:end] for x in h)
            picks = one % (cuts.counts + 1), two % (cuts.counts + 1)
            left, right = cuts.place(np.minimum(*picks)), cuts.place(np.maximum(*picks))
            chosen = (cuts.counts > 0) & (three % 100 < TRANSFORMED)
            sizes = cuts.code_points(cuts.start, left), cuts.code_points(left, right)
            raw, forms, outputs = data.tobytes(), [], []
            for i in range(end - row):
                text, form = raw[cuts.start[i] : cuts.stop[i]], "plain"
                if chosen[i] and not any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE)):
                    form = "spm" if four[i] % 100 < SPM else "psm"
                    a, z = left[i] - cuts.start[i], right[i] - cuts.start[i]
                    parts = {PREFIX: text[:a], MIDDLE: text[a:z], SUFFIX: text[z:]}
                    text = b"".join(s.encode() + parts[s] for s in signs[form])
                forms.append(form)
                outputs.append(text)
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row), pa.array(cuts.counts), pa.array(forms), *(pa.array(s, mask=plain) for s in sizes), pa.array(outputs, pa.binary()).cast(pa.string())],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def transform(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Per document: id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output. One map, no shuffle."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(id_col, seed))))
    schema = f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(_transformed, schema).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. A sign never begins inside a part, as no part holds one and none is a border of another."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix = F.when(F.col(form) == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    suffix = F.when(F.col(form) == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))

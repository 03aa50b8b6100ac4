"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` bytes counts what follows. With the counts frozen, method C's escape
probabilities give each byte an exact code length under each language: the longest context that knows the byte codes it, every
longer known context adds its escape. A text goes to the language that codes it shortest.

The trees are one table: rows are contexts known to any language (a text's bytes lead to the longest), columns bytes, values the code
lengths under all languages. It holds at most ``TABLE_BYTES``, or ``LANGUAGE_BYTES`` for each language if that is more, which bounds
what is broadcast: shorter contexts come first, and of the first order that does not fit the contexts seen least are left out.
``Model.kept`` says how many of each order stayed of how many.

Bytes are folded first: A-Z to a-z, digits to one class, control and white space to one, other ASCII signs to one; the choice inside
a class costs the same in every language.

Edge cases: null text or text without a letter: ``und``, score 0. Ties go to the language first in code point order. No labelled row:
everything is ``und``. A very long text is one sum. Repeated rows and extra columns change nothing; null labels are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import give_back
from .textbytes import slabs

ORDER = 3
#: Bounds of the sample that trains a language: documents, and characters of each (of longer ones an excerpt at a hashed place).
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 300, 20_000
TABLE_BYTES, LANGUAGE_BYTES = 48_000_000, 4_000_000
#: Bytes of text that are scored at once; scoring takes some tens of times as much memory.
SLAB_BYTES = 256_000
#: A label column with more values is no language column, and is refused.
MOST_LANGUAGES = 1000

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
FOLD[[*range(33), 127]] = 32
FOLD[[i for i in range(33, 127) if not chr(i).isalnum() and i != 39]] = 33


def _contexts(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, and the three before each packed in one number; 0 stands for what lies before a text's start."""
    symbols = codes[FOLD[data]].astype(np.int32)
    packed = np.zeros(len(symbols), np.int32)
    heads = offsets[:-1][np.diff(offsets) > 0]
    for back in range(1, ORDER + 1):
        before = np.zeros_like(symbols)
        before[back:] = symbols[:-back]
        for i in range(back):
            at = heads + i
            before[at[at < len(symbols)]] = 0
        packed |= before << (8 * (back - 1))
    return symbols, packed


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, context << 8 | byte, count) of each batch, contexts at full length."""
    same = np.arange(256, dtype=np.uint8)
    same[0] = 32
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for row, end, data, offsets in slabs(batch.column(1)):
            symbols, packed = _contexts(data, offsets, same)
            gram = packed.astype(np.int64) << 8 | symbols
            owner = np.repeat(langs[row:end], np.diff(offsets))
            for lang in sorted(set(langs[row:end])):
                grams, counts = np.unique(gram[owner == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])


class Model:
    """Frozen trees of all languages as one table of code lengths in bits."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        lang_of = {x: i for i, x in enumerate(self.langs)}
        raw = sorted({r[1] & 255 for r in rows})
        self.codes = np.zeros(256, np.uint8)
        self.codes[raw] = np.arange(1, len(raw) + 1)
        width, n_langs = len(raw) + 1, max(1, len(self.langs))
        full = [{} for _ in range(ORDER + 1)]
        for lang, gram, n in rows:
            context = [int(self.codes[gram >> (8 * (k + 1)) & 255]) for k in range(ORDER)]
            byte = int(self.codes[gram & 255])
            for k in range(ORDER + 1):
                slot = full[k].setdefault(sum(c << (8 * j) for j, c in enumerate(context[:k])), {})
                slot[byte, lang_of[lang]] = slot.get((byte, lang_of[lang]), 0) + n
        room = max(1, max(TABLE_BYTES, LANGUAGE_BYTES * n_langs) // (4 * width * n_langs))
        self.kept = []
        for k in range(ORDER + 1):
            # An order is cut only if the shorter ones are whole, so the shorter context of each is in the table.
            most = sorted(full[k], key=lambda c: (-sum(full[k][c].values()), c))[:room]  # noqa: B023
            self.kept.append((len(most), len(full[k])))
            room = room - len(most) if len(most) == len(full[k]) else 0
            full[k] = {c: full[k][c] for c in most}
        # Order -1: every byte the same.
        lengths = {None: np.full((width, n_langs), np.log2(256), np.float32)}
        table, self.rows = [], {}
        for k in range(ORDER + 1):
            for context in sorted(full[k]):
                shorter = lengths[(k - 1, context & ((1 << (8 * (k - 1))) - 1))] if k else lengths[None]
                counts = np.zeros((width, n_langs))
                for (byte, lang), n in full[k][context].items():
                    counts[byte, lang] = n
                total, kinds = counts.sum(axis=0), (counts > 0).sum(axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                    own = -np.log2(counts / (total + kinds))
                bits = np.where(counts > 0, own, shorter + escape).astype(np.float32)
                lengths[(k, context)] = bits
                self.rows[(k, context)] = len(table)
                table.append(bits)
        self.table = np.concatenate(table) if table else np.zeros((1, n_langs), np.float32)
        self.width = width
        self.at = [np.array(sorted(c for j, c in self.rows if j == k), np.int32) for k in range(ORDER + 1)]
        self.node = [np.array([self.rows[(k, int(c))] for c in self.at[k]], np.int32) for k in range(ORDER + 1)]
        self.lookup = None

    def nodes(self, packed: np.ndarray) -> np.ndarray:
        """Row of the longest known context. The direct table is made once in each worker, not sent."""
        if self.lookup is None:
            bits = int(self.width).bit_length()
            self.bits = bits
            self.lookup = np.zeros(1 << (bits * ORDER), np.int32)
            every = np.arange(len(self.lookup), dtype=np.int64)
            for k in range(ORDER + 1):
                if len(self.at[k]):
                    tail = every & ((1 << (bits * k)) - 1)
                    small = sum((self.at[k] >> (8 * j) & 255).astype(np.int64) << (bits * j) for j in range(k)) + np.zeros(len(self.at[k]), np.int64)
                    direct = np.full(1 << (bits * k), -1, np.int32)
                    direct[small] = self.node[k]
                    found = direct[tail]
                    self.lookup[found >= 0] = found[found >= 0]
        small = packed & 255
        for j in range(1, ORDER):
            small = small | (packed >> (8 * j) & 255) << (self.bits * j)
        return self.lookup[small]

    def bits_of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(offsets) - 1, self.table.shape[1]))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            symbols, packed = _contexts(data, offsets, self.codes)
            row = self.nodes(packed).astype(np.int64) * self.width + symbols
            out[full] = np.add.reduceat(self.table[row], offsets[full], axis=0, dtype=np.float64)
        return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model:
    """Learn from at most ``SAMPLE_DOCUMENTS`` documents of each language, drawn by the hash of their key, whatever their length."""
    drawn = F.xxhash64(key_col).bitwiseAND(F.lit(2**40 - 1))
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    spare = F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(0))
    excerpt = F.substring(F.col(text_col), F.pmod(F.xxhash64(F.lit(1), key_col), spare + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
    # One row for each language goes through the driver, and no text is shuffled but the sample.
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels of languages")
    shares = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SAMPLE_DOCUMENTS / n))]
    share = F.element_at(F.create_map(*shares), F.col(lang_col)) if shares else F.lit(0.0)
    # About SAMPLE_DOCUMENTS rows of each language pass, whatever the size of the corpus; the rank then makes the bound strict.
    passed = usable.where(drawn < share * float(2**40)).select(F.col(lang_col).alias("lang"), excerpt.alias("text"), drawn.alias("drawn"))
    chosen = passed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "text"))).where(F.col("rank") <= SAMPLE_DOCUMENTS)
    grams = chosen.select("lang", "text").mapInArrow(_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n"))
    return Model([tuple(r) for r in grams.collect()])


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Per document: id (or with ``keep_columns`` all input columns), lang_pred, score (share of the best language among all, from
    the code lengths), bits_per_byte, accepted.

    A document is rejected if it is ``und`` or no language codes it in under eight bits a byte.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    taken = documents.columns if keep_columns else [id_col]
    kinds = [(f"__c{i}", documents.schema[c].dataType) for i, c in enumerate(taken)]
    verdicts = ["lang_pred", "score", "bits_per_byte"]
    # Every column once: the text is one of those kept, or comes last.
    place = taken.index(text_col) if text_col in taken else len(taken)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for row, end, data, offsets in slabs(batch.column(1 + place), SLAB_BYTES):
                bits = m.bits_of(data, offsets)
                least = bits.min(axis=1)
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                rate = least / np.maximum(1, np.diff(offsets))
                part = batch.slice(row, end - row)
                known = np.array(part.column(0).to_pylist(), bool) & bool(m.langs)
                langs = [m.langs[i] if k else "und" for i, k in zip(bits.argmin(axis=1), known, strict=True)]
                found = [pa.array(langs, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, rate, 0.0))]
                yield pa.RecordBatch.from_arrays([*part.columns[1 : 1 + len(kinds)], *found], [*(k for k, _ in kinds), *verdicts])
        give_back()

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = documents.select(letter.alias("__letter"), *(F.col(c).alias(k) for c, (k, _) in zip(taken, kinds, strict=True)), *([] if text_col in taken else [F.col(text_col).alias("__text")]))
    schema = ", ".join(f"{k} {t.simpleString()}" for k, t in kinds) + ", lang_pred string, score double, bits_per_byte double"
    scored = rows.mapInArrow(score, schema).withColumnsRenamed({k: c for c, (k, _) in zip(taken, kinds, strict=True)})
    return scored.withColumn("accepted", (F.col("lang_pred") != "und") & (F.col("bits_per_byte") < 8))

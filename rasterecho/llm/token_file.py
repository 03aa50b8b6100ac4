"""Token ids in a file of directly addressable codes.

Ids are cut into chunks of ``CHUNK_BITS`` bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of the ids that
have one, and so on; a bitmap for each level says which ids go on, and a rank directory (one count for each 512 bits) finds an id's
place in the next level. Any id is read by one step per level without decoding others.

A token file is a table of segments (Parquet in the shared folder, so that Spark's commit makes lost tasks safe): segment number,
tokens before it, and the coded bytes. Documents lie in ascending id order (null first; ties by text hash) and never share a segment
with a part of another order; a segment holds about ``SEGMENT_TOKENS`` ids, one longer document alone may have more.

Edge cases: a null or empty text is the end id alone; no documents make an empty file; repeated ids keep all their rows; columns other
than id and text are not stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import give_back, keep
from .textbytes import slabs

CHUNK_BITS = 8
SEGMENT_TOKENS = 500_000
END_ID = 1
BLOCK = 512
#: Bytes that a worker's memory of pieces and their ids may take, about: two halves, the older of which goes when the newer is full.
MEMORY_BYTES = 150_000_000
#: Bytes of text that are encoded at once.
SLAB_BYTES = 4_000_000
_HEAD = struct.Struct("<4sBQ")
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.int64)


def encode(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned ids: magic, number of levels, number of ids; per level its chunks, bitmap, directory."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest >> np.uint32(CHUNK_BITS) > 0
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(_POPCOUNT[bits], np.arange(0, len(bits), BLOCK // 8)))]).astype("<u4") if len(bits) else np.zeros(1, "<u4")
        levels.append(((rest & np.uint32(2**CHUNK_BITS - 1)).astype(np.uint8), bits, ranks))
        rest = rest[more] >> np.uint32(CHUNK_BITS)
    out = [_HEAD.pack(b"DAC1", len(levels), len(ids))]
    for chunks, bits, ranks in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Codes:
    """Reads ids at any places of coded bytes."""

    def __init__(self, raw: bytes) -> None:
        magic, n_levels, self.size = _HEAD.unpack_from(raw, 0)
        if magic != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], _HEAD.size
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            n_bytes, n_ranks = (n + 7) // 8, (n + BLOCK - 1) // BLOCK + 1
            chunks = np.frombuffer(raw, np.uint8, n, at)
            bits = np.frombuffer(raw, np.uint8, n_bytes, at + n)
            ranks = np.frombuffer(raw, "<u4", n_ranks, at + n + n_bytes)
            inside = np.concatenate([np.zeros(1, np.int64), np.cumsum(_POPCOUNT[bits])]) if n else np.zeros(1, np.int64)
            self.levels.append((chunks, bits, ranks, inside))
            at += n + n_bytes + 4 * n_ranks

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ids at the places, in their order."""
        places = np.asarray(places, np.int64)
        out, open_, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), 0
        for chunks, bits, ranks, inside in self.levels:
            if not len(open_):
                break
            out[open_] |= chunks[places].astype(np.uint32) << np.uint32(shift)
            more = bits[places >> 3] >> (places & 7).astype(np.uint8) & 1 > 0
            open_, places = open_[more], self._rank(bits, ranks, inside, places[more])
            shift += CHUNK_BITS
        return out

    def run(self, start: int, stop: int) -> np.ndarray:
        """Ids of a run of places: in each level the ids that go on are a run again."""
        out, open_, shift = np.zeros(stop - start, np.uint32), np.arange(stop - start), 0
        for chunks, bits, ranks, inside in self.levels:
            if start >= stop:
                break
            out[open_] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].view(bool)
            open_ = open_[more]
            start = int(self._rank(bits, ranks, inside, np.array([start]))[0])
            stop = start + len(open_)
            shift += CHUNK_BITS
        return out

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, inside: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The directory's count before the block, the bytes since its start, and the bits before the place in its own byte."""
        block, byte = places // BLOCK, places >> 3
        before = _POPCOUNT[bits[byte] & ((1 << (places & 7)) - 1).astype(np.uint8)] if len(places) else places
        return ranks[block].astype(np.int64) + inside[byte] - inside[block * (BLOCK // 8)] + before


class WordEncoder:
    """Ids of whole texts. The tokenizer drops white space and splits at it, so a text's ids are those of its pieces between ASCII
    spaces and line ends, one after another. Arrow splits many texts at once and numbers their distinct pieces; a worker looks those up
    among the pieces that it has met, and numpy gathers the ids of all places.

    A new piece of letters and closing commas or stops is the ids of its lower-cased letters, then those of the signs. New words of
    letters are encoded together in one text; an id that ends a word (its entry ends so in the vocabulary) parts them again. If the
    parts don't come out as many as the words, and for all other pieces, each is encoded for itself.
    """

    WORD_END = "</w>"

    def __init__(self, path: str, memory_bytes: int = MEMORY_BYTES, slab_bytes: int = SLAB_BYTES) -> None:
        from tokenizers import Tokenizer

        self.memory_bytes, self.slab_bytes = memory_bytes, slab_bytes
        self.tokenizer = Tokenizer.from_file(path)
        self.run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for entry, i in vocabulary.items():
            self.ends[i] = entry.endswith(self.WORD_END)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = 0

    def _remember(self, pieces: dict[str, bytes]) -> None:
        self.known |= pieces
        # A dictionary's slot, the heads of a string and of a bytes object, and what they hold.
        self.bytes += sum(map(len, pieces)) + sum(map(len, pieces.values())) + 200 * len(pieces)

    def _each(self, pieces: list[str]) -> dict[str, bytes]:
        return {p: np.array(made.ids, "<u4").tobytes() for p, made in zip(pieces, self.run(pieces, add_special_tokens=False), strict=True)}

    def _together(self, words: list[str]) -> dict[str, bytes]:
        ids = np.array(self.run([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self._each(words)
        raw, stops = ids.tobytes(), (4 * stops).tolist()
        return {w: raw[a:z] for w, a, z in zip(words, [0, *stops[:-1]], stops, strict=True)}

    def _learn(self, fresh: list[str]) -> None:
        split, other = [], []
        for piece in fresh:
            letters = piece.rstrip(",.")
            # The two letters whose lower case depends on their place or makes a sign of its own go the plain way.
            if letters.isalpha() and "\u03a3" not in letters and "\u0130" not in letters:
                split.append((piece, letters.lower(), piece[len(letters) :]))
            else:
                other.append(piece)
        new = list({w for _, w, _ in split}.difference(self.known))
        for i in range(0, len(new), 5000):
            self._remember(self._together(new[i : i + 5000]))
        signs = self._each(sorted({s for _, _, s in split if s}))
        signs[""] = b""
        self._remember({piece: self.known[word] + signs[sign] for piece, word, sign in split if piece != word})
        for i in range(0, len(other), 20_000):
            self._remember(self._each(other[i : i + 20_000]))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has; an end id closes each."""
        if self.bytes > self.memory_bytes // 2:
            self.known, self.older, self.bytes = {}, self.known, 0
        clean = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " ")
        lists = pc.split_pattern(clean, " ")
        numbered = lists.values.dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        coded = list(map(self.known.get, pieces))
        missing = [p for p, c in zip(pieces, coded, strict=True) if c is None]
        if missing:
            met = {p: c for p, c in zip(missing, map(self.older.get, missing), strict=True) if c is not None}
            self._remember(met)
            self._learn([p for p in missing if p not in met])
            coded = [self.known[p] if c is None else c for p, c in zip(pieces, coded, strict=True)]
        # The end id is one more piece, put behind the pieces of each text.
        store = np.frombuffer(b"".join([*coded, np.array([END_ID], "<u4").tobytes()]), "<u4")
        sizes = np.array([*(len(c) // 4 for c in coded), 1], np.int64)
        first = np.cumsum(sizes) - sizes
        bounds = np.asarray(lists.offsets).astype(np.int64)
        which = np.insert(np.asarray(numbered.indices).astype(np.int64), bounds[1:] - bounds[0], len(coded))
        length = sizes[which]
        stops = np.cumsum(length)
        ids = store[np.repeat(first[which] - stops + length, length) + np.arange(stops[-1] if len(stops) else 0)]
        ends = np.cumsum(np.diff(bounds) + 1) - 1
        return ids, np.diff(stops[ends], prepend=0)


_encoders: dict[tuple[str, int, int], WordEncoder] = {}


def _coded(batches: Iterator[pa.RecordBatch], path: str, memory_bytes: int, slab_bytes: int, tidy: bool) -> Iterator[pa.RecordBatch]:
    name = (path, memory_bytes, slab_bytes)
    if name not in _encoders:
        _encoders[name] = WordEncoder(*name)
    encoder = _encoders[name]
    rows: list[tuple] = []
    held: list[np.ndarray] = []
    seg = size = before = 0

    def flush():
        nonlocal rows, held, size, seg, before
        code = encode(np.concatenate(held) if held else np.zeros(0, np.uint32))
        out = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seg], pa.int64()), pa.array([size], pa.int64()), pa.array([before], pa.int64()), pa.array([[{"id": i, "n": n} for i, n in rows]], pa.list_(pa.struct([("id", kind), ("n", pa.int64())]))), pa.array([code], pa.binary())],
            ["part", "seg", "n_tokens", "before", "documents", "code"],
        )
        rows, held, size, seg, before = [], [], 0, seg + 1, before + size
        return out

    from pyspark import TaskContext

    part, kind = TaskContext.get().partitionId(), None
    for batch in batches:
        kind = batch.column(0).type
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for row, end, _, _ in slabs(texts, slab_bytes):
            found, counts = encoder(texts.slice(row, end - row))
            for key, codes in zip(ids[row:end], np.split(found, np.cumsum(counts)[:-1]), strict=True):
                if rows and size + len(codes) > SEGMENT_TOKENS:
                    yield flush()
                rows.append((key, len(codes)))
                held.append(codes)
                size += len(codes)
    if rows:
        yield flush()
    if tidy:
        # What the next task of this worker will hardly ask for goes: the pieces that only the older half remembers.
        encoder.older = {}
        give_back()


def write_tokens(
    documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *,
    memory_bytes: int = MEMORY_BYTES, slab_bytes: int = SLAB_BYTES, tidy: bool = False,
) -> DataFrame:
    """Write the token file of all documents and return its table of segments: part, seg, n_tokens, before (in the part), documents (id, n), code, start.

    ``memory_bytes`` and ``slab_bytes`` bound what a worker remembers and encodes at once, at the cost of encoding pieces again; with
    ``tidy`` a worker gives memory back after each task.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))
    segments = keep(ordered.mapInArrow(lambda b: _coded(b, tokenizer_path, memory_bytes, slab_bytes, tidy), f"part int, seg bigint, n_tokens bigint, before bigint, documents array<struct<id: {kind}, n: bigint>>, code binary"), "segments")
    # One number for each part goes through the driver: parts are as many as shuffle partitions.
    sums = dict(segments.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, total = [], 0
    for part in sorted(sums):
        starts.append((part, total))
        total += sums[part]
    # Proven small: one row of two numbers for each part.
    bases = F.broadcast(spark.createDataFrame(starts, "part int, base bigint"))
    return segments.join(bases, "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, documents, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            codes, at = Codes(code), 0
            ids, starts, counts, sums = [], [], [], []
            for doc in documents:
                got = codes.run(at, at + doc["n"])
                ids.append(doc["id"])
                starts.append(start + at)
                counts.append(doc["n"])
                sums.append(zlib.crc32(got.astype("<u4").tobytes()))
                at += doc["n"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(1).type.value_type.field("id").type), *(pa.array(x, pa.int64()) for x in (starts, counts, sums))], ["id", "start", "n_tokens", "ids_crc32"])


def read_documents(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the file: document id, tokens before it, number of tokens, and the checksum of its ids."""
    kind = segments.schema["documents"].dataType.elementType["id"].dataType.simpleString()
    return segments.select("start", "documents", "code").mapInArrow(_read, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def tokens_at(segments: DataFrame, places: DataFrame, column: str = "place") -> DataFrame:
    """(place, id) for a table of global token places: each is joined with its segment and read there alone."""
    width = SEGMENT_TOKENS
    spans = segments.select("start", "n_tokens", "code", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n_tokens") - 1) / width))).alias("cell"))
    asked = places.select(F.col(column).alias("place"), F.floor(F.col(column) / width).alias("cell")).groupBy("cell").agg(F.collect_set("place").alias("places"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, code, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes = Codes(code)
                wanted = np.array([w for w in wanted if start <= w < start + codes.size], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(codes.at(wanted - start).astype(np.int64))], ["place", "id"])

    return spans.join(asked, "cell").select("start", "code", "places").mapInArrow(pick, "place bigint, id bigint")

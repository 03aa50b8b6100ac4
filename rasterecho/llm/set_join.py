"""Exact n-gram Jaccard join by inverted lists with set-relation skipping.

* Sets are sorted in one order of all shingles: first those that no other set seems to hold, common ones last. Two sets that link share
  a shingle among the first of each, so only those are listed. A list entry knows its place in its set; from it follows the largest
  partner it can still link with (``reach``).
* Lists are cut into blocks by size and place. Whole blocks are skipped by their least size and greatest reach; of lists with the same
  members only the first in the order is kept, as it reaches furthest.
* Relations between sets spare the rest: equal sets are one class; a list is first answered for one of its sets (a star around the class
  with most company, then around one outside its component); members that are in one component by then need no more answers. What is
  still apart is answered set by set, each from the answers of a similar set before it: only shingles that one has and the other has not
  are looked up in the index of the block.
* A parity bitmap of about one bit a shingle rules out pairs first. Two bitmaps differ in at most as many bits as the sets differ in
  shingles, so nothing is lost. Every link is confirmed on full sets.

Edge cases: null or empty text, or no word: size 0, linked with nothing, own component. One or two words: the whole sequence is the one
shingle. Rows that share an id keep one row each; the component id is the smallest id of all rows reachable, a null id never counts as
smallest. Extra columns are ignored, whatever their names. No documents make an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dup import SLAB_BYTES, components
from .scratch import give_back, keep, small_batches
from .textbytes import NON_SPACE, mix, sequence_hash, slabs, word_bounds, word_hashes

SHINGLE = 3
SIMILARITY = 90  # percent
#: A listed shingle is common if more than one in so many entries are its own; so at most so many can be, which bounds what is broadcast.
COMMON, LEAST_COMMON = 20_000, 50
#: Bits that say of a shingle whether several sets hold it. They only choose the order: when they fill up, it is that of the hashes.
SHARED_BITS, SHARED_CHUNK = 1 << 25, 1 << 13
#: How many times as many shingles are counted as are listed.
COUNTED = 2
STARS = 2
#: Members of a part of a block, and their shingles: bounds of a task's memory.
PART, PART_SHINGLES = 512, 1_000_000
#: Bits of the filter over ids whose texts are read again.
FILTER_BITS = 1 << 22
LEAST_BITS = 256


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if not len(words):
        return words
    if len(words) < SHINGLE:
        return sequence_hash(words, len(words)) ^ np.uint64(len(words))
    return np.unique(sequence_hash(words, SHINGLE))


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    for row, end, data, offsets in slabs(column, SLAB_BYTES):
        starts, ends, first = word_bounds(data, offsets, NON_SPACE)
        hashes = word_hashes(data, starts, ends, NON_SPACE)
        for i in range(end - row):
            yield shingle_set(hashes[first[i] : first[i + 1]])


def class_of(shingles: np.ndarray) -> bytes:
    return np.array([shingles.sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)]).tobytes()


def listed(size: int) -> int:
    """How many shingles of a set are listed: all but the first so many can be missing from a partner."""
    return size - (SIMILARITY * size + 99) // 100 + 1


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit; the number of bits is a power of two, at least that of shingles."""
    n = max(LEAST_BITS, 1 << (max(1, len(shingles)) - 1).bit_length())
    bits = np.bincount((mix(shingles) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (or several, in rows) in fewer bits."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def may_link(size: np.ndarray | int, other: np.ndarray | int, apart: np.ndarray | int) -> np.ndarray | bool:
    """Whether two sets that differ in ``apart`` shingles link; with fewer than they differ in, whether they may."""
    return 100 * (size + other - apart) >= SIMILARITY * (size + other + apart)


def _signed(x: np.ndarray) -> np.ndarray:
    """Signed numbers in the order of the unsigned hashes, as Spark has them."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, front): the first shingles of each text by their hashes alone, to be counted."""
    for batch in batches:
        sets = [s for s in sets_of(batch.column(0)) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.binary()), pa.array([_signed(s[: COUNTED * listed(len(s))]) for s in sets], pa.list_(pa.int64()))], ["cls", "front"])
    give_back()


class Order:
    """The order of all shingles: by hash, but shared ones after those held once, and common ones after all."""

    def __init__(self, shared: np.ndarray, common: np.ndarray) -> None:
        self.shared, self.common = shared, common

    def front(self, shingles: np.ndarray) -> np.ndarray:
        """The listed shingles of a sorted set, first to last."""
        bit = shingles & np.uint64(SHARED_BITS - 1)
        level = (self.shared[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
        level[np.isin(shingles, self.common)] = 2
        return shingles[np.argsort(level, kind="stable")][: listed(len(shingles))]


def _fingerprints(batches: Iterator[pa.RecordBatch], order: Order) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_shingles", "cls", "front", "bits"]
    for batch in batches:
        sizes, classes, fronts, maps = [], [], [], []
        for s in sets_of(batch.column(1)):
            sizes.append(len(s))
            classes.append(class_of(s) if len(s) else None)
            fronts.append(_signed(order.front(s)) if len(s) else None)
            maps.append(bitmap(s).tobytes() if len(s) else None)
        columns = [pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(fronts, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)
    give_back()


def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) rows to (class, set) rows; a row whose text is of another class shares its id with one, and goes."""
    for batch in batches:
        out = [(c, s.tobytes()) for c, s in zip(batch.column(0).to_pylist(), sets_of(batch.column(1)), strict=True) if len(s) and class_of(s) == c]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())], ["cls", "shingles"])
    give_back()


def _full_sets(needed: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles) of the classes named, from the text of one of each class's rows.

    A filter of fixed size over the ids that are needed keeps most other texts out of the shuffle; it lets some through, none is lost.
    """
    needed = keep(needed.join(classes.select("cls", "id"), "cls"), "needed")
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = needed.select(cell("id").alias("c")).groupBy((F.col("c") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(c % 64 AS INT))")).alias("bits")
    )
    # Proven small: one row for each 64 bits of the filter at most.
    words = F.broadcast(words)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    at = cell("id")
    texts = texts.withColumns({"w": (at / 64).cast("int"), "b": (at % 64).cast("int")}).join(words, "w").where("(shiftrightunsigned(bits, b) & 1) = 1")
    sets = texts.drop("w", "b", "bits").join(needed, texts.id.eqNullSafe(needed.id)).select("cls", "text").mapInArrow(_class_sets, "cls binary, shingles binary")
    return keep(sets.dropDuplicates(["cls"]), "sets")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for places in batch.column(1).to_pylist():
            bits = np.zeros(SHARED_CHUNK, np.uint8)
            bits[places] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["chunk", "bits"])


def order_of(documents: DataFrame, text_col: str) -> Order:
    """Counts the first shingles of all classes. Common are those with more than one in ``COMMON`` of all entries, so at most ``COMMON``."""
    fronts = documents.select(text_col).mapInArrow(_fronts, "cls binary, front array<bigint>").dropDuplicates(["cls"])
    counts = fronts.select(F.explode("front").alias("token")).groupBy("token").count().where(F.col("count") > 1)
    counts = keep(counts, "counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    common = counts.where(F.col("count") > max(LEAST_COMMON, total // COMMON)).select("token").collect()
    bit = F.col("token").bitwiseAND(F.lit(SHARED_BITS - 1))
    chunks = counts.select((bit / SHARED_CHUNK).cast("int").alias("chunk"), (bit % SHARED_CHUNK).cast("int").alias("at")).groupBy("chunk").agg(F.collect_set("at"))
    # Fixed size: a row of SHARED_CHUNK bits for each chunk.
    shared = np.zeros(SHARED_BITS // 8, np.uint8)
    for row in chunks.mapInArrow(_packed, "chunk int, bits binary").collect():
        shared[row.chunk * SHARED_CHUNK // 8 : (row.chunk + 1) * SHARED_CHUNK // 8] = np.frombuffer(row.bits, np.uint8)
    return Order(shared, np.array(sorted(r.token for r in common), np.int64).view(np.uint64) ^ np.uint64(1 << 63))


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(token, n, cls, size, reach): entries of the lists with at least two members, one list of those with equal members."""
    # 19 * rest >= 9 * (size + other) at 90 percent: what is left of the set from here on must hold all that the two share.
    most = F.floor((100 + SIMILARITY) * (F.col("n_shingles") - F.col("at")) / SIMILARITY) - F.col("n_shingles")
    entries = classes.select("cls", "n_shingles", F.posexplode("front").alias("at", "token"))
    entries = entries.select("token", "at", "cls", F.col("n_shingles").alias("size"), most.alias("reach"))
    lists = entries.groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "cls")).alias("y"), F.min_by("at", "cls").alias("place")
    )
    # Equal members hold the shingles of their lists in one order, so any one of them tells which is first.
    firsts = lists.where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("place", "token"))["token"].alias("token"))
    return keep(entries.drop("at").join(firsts.select("token", "n"), "token"), "lists")


def _compatible(a: str, b: str) -> Column:
    """Entries of one list whose sizes and places let them link."""
    size, other = F.col(f"{a}size"), F.col(f"{b}size")
    return (
        (other <= F.col(f"{a}reach")) & (size <= F.col(f"{b}reach"))
        & (100 * F.least(size, other) >= SIMILARITY * F.greatest(size, other))
    )


def _star(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs of each list's center with the members that may link with it, and are in other components.

    The center is the class with most company; later the one with most outside that one's component.
    """
    entry = F.struct("degree", "cls", "size", "reach")
    if labels is None:
        named = lists.withColumn("component", F.col("cls"))
        centers = named.groupBy("token").agg(F.max(entry).alias("c")).withColumn("own", F.col("c.cls"))
    else:
        named = keep(lists.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "named")
        tops = keep(named.groupBy("token", "component").agg(F.max(entry).alias("top")), "tops")
        first = tops.groupBy("token").agg(F.max("top").alias("most"))
        second = tops.join(first, "token").where("top != most").groupBy("token").agg(F.max(F.struct("top", "component")).alias("s"))
        centers = second.select("token", F.col("s.top").alias("c"), F.col("s.component").alias("own"))
    centers = centers.select("token", "own", F.col("c.cls").alias("center"), F.col("c.size").alias("c_size"), F.col("c.reach").alias("c_reach"))
    pairs = named.join(centers, "token").where((F.col("component") != F.col("own")) & _compatible("", "c_"))
    return pairs.select(F.least("cls", "center").alias("a"), F.greatest("cls", "center").alias("b")).distinct()


def _not_ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for s, t, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            least = min(len(x), len(y))
            good.append(bool(may_link(s, t, int(np.bitwise_count(fold(x, least) ^ fold(y, least)).sum()))))
        yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(bool(may_link(len(x), len(y), len(x) + len(y) - 2 * both)))
        yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])


EDGE = "a binary, b binary"


def _verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes that link: bitmaps first, then full sets."""
    side = lambda c, s, x: classes.select(F.col("cls").alias(c), F.col("n_shingles").alias(s), F.col("bits").alias(x))
    near = pairs.join(side("a", "s", "x"), "a").join(side("b", "t", "y"), "b").select("a", "b", "s", "t", "x", "y").mapInArrow(_not_ruled_out, EDGE)
    near = keep(near, "pairs")
    sets = _full_sets(near.select(F.col("a").alias("cls")).union(near.select("b")).distinct(), classes, documents, id_col, text_col)
    both = near.join(sets.withColumnsRenamed({"cls": "b", "shingles": "y"}), "b").join(sets.withColumnsRenamed({"cls": "a", "shingles": "x"}), "a")
    return keep(both.select("a", "b", "x", "y").mapInArrow(_linked, EDGE), "links")


class Part:
    """The members of a part of a block, as arrays; ``homes`` numbers their components."""

    def __init__(self, classes: list[bytes], sizes: list[int], reaches: list[int], components: list[bytes], payload: list[bytes]) -> None:
        self.cls, self.component = classes, components
        self.size, self.reach = np.array(sizes, np.int64), np.array(reaches, np.int64)
        self.payload = [np.frombuffer(p, np.uint64) for p in payload]


def _fitting(left: Part, right: Part) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of one part, those of another that it may link with by component, size and place."""
    number: dict[bytes, int] = {}
    mine, theirs = ([number.setdefault(c, len(number)) for c in side.component] for side in (left, right))
    home, other = np.array(theirs), right.size
    for i, (size, far) in enumerate(zip(left.size, left.reach, strict=True)):
        fits = (other <= far) & (size <= right.reach) & (100 * np.minimum(size, other) >= SIMILARITY * np.maximum(size, other)) & (home != mine[i])
        yield i, np.flatnonzero(fits)


def candidates(left: Part, right: Part) -> tuple[np.ndarray, np.ndarray]:
    """The members of two parts that may link with any of the other part, by bitmap too."""
    hit = np.zeros(len(left.cls), bool), np.zeros(len(right.cls), bool)
    least = min(len(m) for m in left.payload + right.payload)
    x, y = (np.array([fold(m, least) for m in side.payload]) for side in (left, right))
    for i, fits in _fitting(left, right):
        if len(fits):
            apart = np.bitwise_count(x[i] ^ y[fits]).sum(axis=1).astype(np.int64)
            near = fits[may_link(left.size[i], right.size[fits], apart)]
            hit[0][i] = len(near) > 0
            hit[1][near] = True
    return hit


#: What names a pair of parts.
_IDS = ["token", "block_size", "block_front", "part", "other_size", "other_front", "other_part"]
_MEMBER = ("cls", "size", "reach", "component")
_SURVIVOR = "cls binary, size bigint, reach bigint, component binary, side int"


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two parts (five lists each, behind what names the pair) to a row for each member that may link with any of the other part."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[len(_IDS) :]]
        at, out = [], []
        for row in range(batch.num_rows):
            sides = [Part(*(c[row] for c in columns[k : k + 5])) for k in (0, 5)]
            for k, (side, hit) in enumerate(zip(sides, candidates(*sides), strict=True)):
                for i in np.flatnonzero(hit):
                    at.append(row)
                    out.append((side.cls[i], int(side.size[i]), int(side.reach[i]), side.component[i], k))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
        found = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(_IDS)]), *found], [*_IDS, *_MEMBER, "side"])
    give_back()


class Answers:
    """Sizes of the intersections of sets with each set of a block, found from its index of shingles.

    The answers of a set are those of a similar one before it, mended: shingles that are new count up, shingles that are gone count down.
    """

    def __init__(self, block: list[np.ndarray]) -> None:
        flat, owner = np.concatenate(block), np.repeat(np.arange(len(block)), [len(s) for s in block])
        order = np.argsort(flat, kind="stable")
        self.tokens, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.owner, self.n = owner[order], len(block)
        self.known: tuple[np.ndarray, np.ndarray] | None = None
        self.looked_up = 0

    def _counts(self, tokens: np.ndarray) -> np.ndarray:
        self.looked_up += len(tokens)
        at = np.searchsorted(self.tokens, tokens)
        inside = at < len(self.tokens)
        at = at[inside][self.tokens[at[inside]] == tokens[inside]]
        low, size = self.first[at], self.first[at + 1] - self.first[at]
        places = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[places], minlength=self.n)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        if self.known is not None:
            before, counts = self.known
            new, gone = np.setdiff1d(tokens, before, assume_unique=True), np.setdiff1d(before, tokens, assume_unique=True)
            if len(new) + len(gone) < len(tokens):
                return counts + self._counts(new) - self._counts(gone)
        self.known = tokens, self._counts(tokens)
        return self.known[1]


def answered(left: Part, right: Part) -> list[tuple[bytes, bytes]]:
    """Links between two parts, of each group that they join only as many as join it."""
    found: list[tuple[bytes, bytes]] = []
    sizes, answers = np.array([len(s) for s in right.payload]), Answers(right.payload)
    parent: dict[bytes, bytes] = {}

    def root(c: bytes) -> bytes:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for i, fits in _fitting(left, right):
        own = root(left.component[i])
        fits = np.array([j for j in fits if root(right.component[j]) != own], np.int64)
        if len(fits):
            tokens = left.payload[i]
            both = answers(tokens)[fits]
            for j in fits[may_link(len(tokens), sizes[fits], len(tokens) + sizes[fits] - 2 * both)]:
                a, b = root(left.component[i]), root(right.component[j])
                if a != b:
                    parent[a] = b
                    found.append((min(left.cls[i], right.cls[j]), max(left.cls[i], right.cls[j])))
    return found


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[bytes, bytes]] = []
        for values in zip(*batch.columns, strict=True):
            found += answered(*(Part(*(v.as_py() for v in values[k : k + 5])) for k in (0, 5)))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])
    give_back()


def _lists(prefix: str, payload: str) -> list[Column]:
    """Aggregates that make the five lists of a part; all in the order of the rows that come in."""
    every = F.collect_list(F.struct(*_MEMBER, payload))
    return [every[c].alias(f"{prefix}_{c}") for c in (*_MEMBER, payload)]


def _rest(lists: DataFrame, labels: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """Links that no star found: blocks of the lists whose members are in several components, block by block."""
    named = keep(lists.join(labels, "cls", "left").select("token", "n", "cls", "size", "reach", F.coalesce("component", "cls").alias("component")), "named")
    open_ = named.where("n > 2").groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token")
    open_ = keep(open_, "open")
    if open_.isEmpty():
        return None
    # Partners differ in size by a ninth at most, so they are in one size block or in two neighbours; entries too far back in their sets to
    # meet an equal one can only be the larger.
    size_block = F.floor(F.log(F.col("size")) / float(np.log(100 / SIMILARITY))).cast("int")
    named = keep(named.join(open_, "token").withColumns({"block_size": size_block, "block_front": (F.col("reach") >= F.col("size")).cast("int")}), "open-members")
    block = ["token", "block_size", "block_front"]
    parts = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int")
    blocks = named.groupBy(*block).agg(
        parts.alias("parts"), F.min("size").alias("low"), F.max("size").alias("high"), F.max("reach").alias("far"),
        F.min("component").alias("c_low"), F.max("component").alias("c_high"),
    )
    blocks = keep(blocks, "blocks")
    other = blocks.select("token", *[F.col(c).alias(f"other_{c.removeprefix('block_')}") for c in blocks.columns if c != "token"])
    front = F.col("block_front") + F.col("other_front") > 0
    near = (100 * F.col("other_high") >= SIMILARITY * F.col("low")) & (100 * F.col("high") >= SIMILARITY * F.col("other_low"))
    reached = (F.col("other_low") <= F.col("far")) & (F.col("low") <= F.col("other_far"))
    apart = (F.col("c_low") != F.col("c_high")) | (F.col("other_c_low") != F.col("other_c_high")) | (F.col("c_low") != F.col("other_c_low"))
    once = F.struct("block_size", "block_front") <= F.struct(F.col("other_size").alias("block_size"), F.col("other_front").alias("block_front"))
    pairs = blocks.join(other, "token").where(once & front & near & reached & apart)
    pairs = pairs.select(*block, "other_size", "other_front", "other_parts", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    pairs = pairs.select(*block, "other_size", "other_front", "part", F.explode(F.expr("sequence(0, other_parts - 1)")).alias("other_part"))
    pairs = keep(pairs.where("block_size != other_size OR block_front != other_front OR part <= other_part"), "block-pairs")
    met = pairs.select(*block).union(pairs.select("token", "other_size", "other_front")).distinct()
    members = named.join(blocks.select(*block, "parts"), block).join(met, block, "left_semi").join(classes.select("cls", "bits"), "cls")
    members = members.withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    # One row for each part, its members in lists; the two sides are written apart, so that they are different tables to the analyzer.
    parts_of = keep(members.groupBy(*block, "part").agg(*_lists("left", "bits")), "parts")
    as_other = {"block_size": "other_size", "block_front": "other_front", "part": "other_part"}
    others = parts_of.withColumnsRenamed(as_other | {c: c.replace("left", "right") for c in parts_of.columns if c.startswith("left_")})
    met = pairs.join(parts_of, [*block, "part"]).join(others, ["token", *as_other.values()])
    lists_of = [f"{side}_{c}" for side in ("left", "right") for c in (*_MEMBER, "bits")]
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in _IDS)
    survivors = keep(met.select(*_IDS, *lists_of).mapInArrow(_survivors, f"{kinds}, {_SURVIVOR}"), "survivors")
    sets = _full_sets(survivors.select("cls").distinct(), classes, documents, id_col, text_col)
    full = survivors.join(sets, "cls")
    left, right = (keep(full.where(F.col("side") == k).groupBy(*_IDS).agg(*_lists(name, "shingles")), name) for k, name in enumerate(("left", "right")))
    lists_of = [c.replace("bits", "shingles") for c in lists_of]
    return keep(left.join(right, _IDS).select(*lists_of).mapInArrow(_answered, EDGE).distinct(), "rest")


def _labelled(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows' sizes and classes, and the component of each class that has a link; both kept."""
    kind = documents.schema[id_col].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(order_of(documents, text_col))
    prints = documents.select(id_col, text_col).mapInArrow(
        lambda b: _fingerprints(b, sent.value), f"id {kind}, n_shingles bigint, cls binary, front array<bigint>, bits binary"
    )
    prints = keep(prints, "prints")
    first = lambda c: F.first(c).alias(c)
    classes = prints.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("id"), first("n_shingles"), first("front"), first("bits"))
    classes = keep(classes, "classes")
    lists = inverted_lists(classes)
    lists = keep(lists.join(lists.groupBy("cls").agg(F.sum("n").alias("degree")), "cls"), "degrees")
    tested = links = labels = None
    for _ in range(STARS):
        star = _star(lists, labels)
        if tested is not None:
            star = star.join(tested, ["a", "b"], "left_anti")
        star = keep(star, "star")
        if star.isEmpty() and links is not None:
            break
        tested = star if tested is None else tested.union(star)
        found = _verified(star, classes, documents, id_col, text_col)
        links = found if links is None else links.union(found)
        labels = components(links)
    rest = _rest(lists, labels, classes, documents, id_col, text_col)
    if rest is not None and not rest.isEmpty():
        labels = components(links.union(rest))
    return prints, labels


def similar_sets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links)."""
    with small_batches(documents.sparkSession):
        prints, labels = _labelled(documents, id_col, text_col)
    rows = prints.select("id", "n_shingles", "cls").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("smallest"))
    return rows.join(smallest, "component", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("smallest", "id").alias("component_id"))

"""Near-duplicate groups by circulant MinHash, bands and exact Jaccard checks.

Two permutations make all coordinates: the first scrambles the shingle universe, the second is read at ``x + k`` (circularly)
for coordinate ``k``. Texts with equal shingle sets are one class; only classes are banded, compared and joined.

Edge cases: null or empty text, or no word: size 0, linked with nothing, own component. One to four words: the whole sequence is
the one shingle. Rows that share an id keep one row each; the component id is the smallest id of all rows reachable. A null id
never counts as smallest; ``kept`` is false for it unless it stands alone. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import give_back, keep, mark, release, small_batches
from .textbytes import NON_SPACE, mix, sequence_hash, slabs, word_bounds, word_hashes

SHINGLE = 5
SIMILARITY = 75  # percent
ROWS, BANDS = 4, 32  # a pair at 0.75 misses all bands with probability 5e-6
COORDINATES = ROWS * BANDS
UNIVERSE_BITS = 20
#: Pairs that agree in fewer coordinates are not compared in full: at 0.75 that is 4.5 standard deviations away, a chance of 4e-6,
#: like that of missing all bands.
LEAST_AGREEMENT = 74
STARS = 2
#: Members and shingles of a chunk (a bound on a task's memory), and columns of the dense tables in which two chunks are compared.
CHUNK, CHUNK_SHINGLES = 512, 1_000_000
COLUMNS = 4096
#: Bytes of text whose words are hashed at once; that takes some tens of times as much memory.
SLAB_BYTES = 1_000_000

_rng = np.random.default_rng(11)
_FIRST = _rng.permutation(2**UNIVERSE_BITS).astype(np.int32)
_SECOND = _rng.permutation(2**UNIVERSE_BITS).astype(np.int32)
_SHIFTED = np.lib.stride_tricks.sliding_window_view(np.concatenate([_SECOND, _SECOND[:COORDINATES]]), COORDINATES)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if not len(words):
        return words
    if len(words) < SHINGLE:
        return sequence_hash(words, len(words)) ^ np.uint64(len(words))
    return np.unique(sequence_hash(words, SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    place = _FIRST[shingles >> np.uint64(64 - UNIVERSE_BITS)]
    best = np.full(COORDINATES, 2**UNIVERSE_BITS, np.int32)
    for i in range(0, len(place), 8192):
        np.minimum(best, _SHIFTED[place[i : i + 8192]].min(axis=0), out=best)
    return best


def class_of(shingles: np.ndarray) -> bytes:
    return np.array([shingles.sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for row, end, data, offsets in slabs(column, SLAB_BYTES):
        starts, ends, first = word_bounds(data, offsets, NON_SPACE)
        hashes = word_hashes(data, starts, ends, NON_SPACE)
        for i in range(end - row):
            yield shingle_set(hashes[first[i] : first[i + 1]])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    weights = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
    for batch in batches:
        ids, sizes, classes, bands, signatures = batch.column(0), [], [], [], []
        for shingles in _sets(batch.column(1)):
            sizes.append(len(shingles))
            if not len(shingles):
                classes.append(None)
                bands.append(None)
                signatures.append(None)
                continue
            s = signature(shingles)
            classes.append(class_of(shingles))
            keys = mix((mix(s.astype(np.uint64).reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64)) ^ salt)
            bands.append(keys.astype(np.int64))
            signatures.append(s.astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
            ["id", "n_shingles", "cls", "bands", "signature"],
        )
    give_back()


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, COORDINATES) for c in (b.column(2), b.column(3)))
            b = b.filter(pa.array((x == y).sum(axis=1) >= LEAST_AGREEMENT))
        yield b.select([0, 1])


def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) rows to (class, set) rows; a row whose text is of another class has the id of one in common and goes."""
    for batch in batches:
        out = [(c, s.tobytes()) for c, s in zip(batch.column(0).to_pylist(), _sets(batch.column(1)), strict=True) if len(s) and class_of(s) == c]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())], ["cls", "shingles"])
    give_back()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = 0
            if 100 * min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
        yield b.filter(pa.array(good, pa.bool_())).select([0, 1])
    give_back()


EDGE = "a binary, b binary"


def _full_sets(needed: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles) of the classes named, from the text of one of each class's rows."""
    needed = needed.join(classes.select("cls", "id"), "cls")
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = (
        texts.join(needed, texts.id.eqNullSafe(needed.id)).select("cls", "text")
        .mapInArrow(_class_sets, "cls binary, shingles binary").dropDuplicates(["cls"])
    )
    return keep(sets, "sets")


def _verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    signed = classes.select("cls", "signature")
    near = (
        pairs.join(signed.withColumnsRenamed({"cls": "a", "signature": "s"}), "a")
        .join(signed.withColumnsRenamed({"cls": "b", "signature": "t"}), "b")
        .select("a", "b", "s", "t").mapInArrow(_agreeing, EDGE)
    )
    near = keep(near, "pairs")
    sets = _full_sets(near.select(F.col("a").alias("cls")).union(near.select("b")).distinct(), classes, documents, id_col, text_col)
    return keep(
        near.join(sets.withColumnsRenamed({"cls": "b", "shingles": "y"}), "b")
        .join(sets.withColumnsRenamed({"cls": "a", "shingles": "x"}), "a")
        .select("a", "b", "x", "y").mapInArrow(_linked, EDGE),
        "links",
    )


def components(edges: DataFrame) -> DataFrame:
    """(cls, component) for every end of an edge, by rounds of contraction; a fresh hash order in each round bounds their number."""
    steps, turn = [], 0
    edges = edges.where("a != b")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        step = keep(both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("v"), F.least(rank("a"), "best")["v"].alias("to")), "step")
        steps.append(step)
        edges = keep(
            edges.join(step.withColumnsRenamed({"v": "a", "to": "x"}), "a").join(step.withColumnsRenamed({"v": "b", "to": "y"}), "b")
            .where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        turn += 1
    if not steps:
        return edges.select(F.col("a").alias("cls"), F.col("b").alias("component"))
    labels = steps[0].withColumnsRenamed({"v": "cls", "to": "component"})
    for step in steps[1:]:
        labels = labels.join(step, labels.component == step.v, "left").select("cls", F.coalesce("to", "component").alias("component"))
    return keep(labels, "labels")


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set of one list with each of another."""
    flat = [np.concatenate(side) for side in (x, y)]
    shared = np.intersect1d(*flat)
    sides = []
    for side, values in zip((x, y), flat, strict=True):
        owner = np.repeat(np.arange(len(side)), [len(v) for v in side])
        at = np.searchsorted(shared, values)
        inside = at < len(shared)
        inside[inside] = shared[at[inside]] == values[inside]
        order = np.argsort(at[inside], kind="stable")
        sides.append((len(side), owner[inside][order], at[inside][order]))
    out = np.zeros((len(x), len(y)), np.int64)
    for start in range(0, len(shared), COLUMNS):
        dense = []
        for n, owner, at in sides:
            low, high = np.searchsorted(at, [start, start + COLUMNS])
            dense.append(np.zeros((n, COLUMNS), np.float32))
            dense[-1][owner[low:high], at[low:high] - start] = 1
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links between two chunks of a bucket: pairs in different components whose full sets are similar enough."""
    none = pd.DataFrame({"a": [], "b": []}, dtype=object)
    if not len(left) or not len(right):
        return none
    y = np.frombuffer(b"".join(right.signature), np.uint16).reshape(-1, COORDINATES)
    near = np.array([(y == np.frombuffer(s, np.uint16)).sum(axis=1) >= LEAST_AGREEMENT for s in left.signature])
    near &= left.component.to_numpy()[:, None] != right.component.to_numpy()[None, :]
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return none
    p, q = ([np.frombuffer(v, np.uint64) for v in side.shingles.iloc[at]] for side, at in ((left, rows), (right, cols)))
    both = _common(p, q)
    total = np.array([len(v) for v in p])[:, None] + np.array([len(v) for v in q])[None, :]
    i, j = np.nonzero(near[np.ix_(rows, cols)] & (100 * both >= SIMILARITY * (total - both)))
    x, z = left.cls.iloc[rows[i]].tolist(), right.cls.iloc[cols[j]].tolist()
    found = sorted({(min(pair), max(pair)) for pair in zip(x, z, strict=True)})
    return pd.DataFrame(found, columns=["a", "b"]) if found else none


def _rest(members: DataFrame, labels: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """Links of a bucket that no star found: members in different components, compared chunk by chunk on their full sets.

    The sets come to the chunks, so that a bucket whose members are nearly similar enough makes no row for each of its pairs. Chunks
    are bounded by members and by shingles. A component with over a chunk of members in a bucket has chunks of its own, which are not
    held against each other.
    """
    named = keep(members.join(labels, "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("component")), "named")
    open_keys = keep(
        named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x != y AND n > 2").select("key"),
        "open",
    )
    if open_keys.isEmpty():
        return None
    named = keep(named.join(open_keys, "key").join(classes.select("cls", "n_shingles"), "cls"), "open-members")
    chunks_of = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n_shingles") / CHUNK_SHINGLES))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"), chunks_of.alias("parts"))
    small = named.join(sizes.where(F.col("n") < CHUNK), ["key", "component"]).groupBy("key").agg(chunks_of.alias("small_parts"))
    placed = (
        named.join(sizes, ["key", "component"]).join(small, "key", "left")
        .withColumn("big", F.when(F.col("n") >= CHUNK, F.col("component")))
        .withColumn("part", F.pmod(F.xxhash64("cls"), F.when(F.col("n") >= CHUNK, F.col("parts")).otherwise(F.col("small_parts"))))
        .withColumn("chunk", F.struct(F.coalesce("big", F.lit(b"")).alias("big"), "part"))
        .join(classes.select("cls", "signature"), "cls").select("key", "big", "chunk", "cls", "component", "signature")
    )
    placed = keep(placed, "placed")
    chunks = placed.select("key", "chunk", "big").distinct()
    other = chunks.select("key", F.col("chunk").alias("other"), F.col("big").alias("other_big"))
    pairs = chunks.join(other, "key").where("chunk <= other AND NOT coalesce(big = other_big, false)").select("key", "chunk", "other")
    pairs = keep(pairs, "chunk-pairs")
    sets = _full_sets(placed.select("cls").distinct(), classes, documents, id_col, text_col)
    # Written apart, so that the two sides are different tables to the analyzer.
    left, right = (
        keep(pairs.join(placed.withColumnRenamed("chunk", c), ["key", c]).join(sets, "cls").select("key", "chunk", "other", "cls", "component", "signature", "shingles"), c)
        for c in ("chunk", "other")
    )
    keys = ["key", "chunk", "other"]
    return keep(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_across, EDGE).distinct(), "rest")


def _star(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs of each bucket's center with its members of other components.

    At first everyone is a component of their own and the center has the highest degree; later it is the highest outside the
    component that the highest of all belongs to, so that another center gets its turn.
    """
    best = F.struct("degree", "cls")
    if labels is None:
        centers = members.groupBy("key").agg(F.max(best)["cls"].alias("center"))
        pairs = members.join(centers, "key").where("cls != center")
    else:
        named = keep(members.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "named")
        tops = keep(named.groupBy("key", "component").agg(F.max(best).alias("top")), "tops")
        first = tops.groupBy("key").agg(F.max("top").alias("most"))
        second = tops.join(first, "key").where("top != most").groupBy("key").agg(F.max(F.struct("top", "component")).alias("c"))
        centers = second.select("key", F.col("c.top.cls").alias("center"), F.col("c.component").alias("own"))
        pairs = named.join(centers, "key").where("component != own")
    return pairs.select(F.least("cls", "center").alias("a"), F.greatest("cls", "center").alias("b")).distinct()


def _labelled(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows' sizes and classes, and the component of each class that has a link; both kept."""
    spark = documents.sparkSession
    start = mark(spark)
    prints = keep(documents.select(id_col, text_col).mapInArrow(_fingerprints, f"id {documents.schema[id_col].dataType.simpleString()}, n_shingles bigint, cls binary, bands array<bigint>, signature binary"), "prints")
    full = prints.where("n_shingles > 0")
    classes = keep(full.groupBy("cls").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    # Bands and signatures are read from the classes from here on.
    slim = keep(prints.select("id", "n_shingles", "cls"), "sizes")
    release(spark, start, start + 1)
    banded = classes.select("cls", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("cls").alias("x"), F.max("cls").alias("y"), F.count("*").alias("n")).where("x != y").select("key", "n")
    members = keep(banded.join(shared, "key"), "members")
    # The text that others were copied from meets most of them in most buckets: the best center of a star.
    members = keep(members.join(members.groupBy("cls").agg(F.sum("n").alias("degree")), "cls").select("key", "cls", "degree"), "degrees")
    tested = links = labels = None
    for _ in range(STARS):
        star = _star(members, labels)
        if tested is not None:
            star = star.join(tested, ["a", "b"], "left_anti")
        star = keep(star, "star")
        if star.isEmpty() and links is not None:
            break
        tested = star if tested is None else tested.union(star)
        found = _verified(star, classes, documents, id_col, text_col)
        links = found if links is None else links.union(found)
        labels = components(links)
    rest = _rest(members.select("key", "cls"), labels, classes, documents, id_col, text_col)
    if rest is not None and not rest.isEmpty():
        labels = components(links.union(rest))
    return slim, labels


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Every bucket is first compared as a star around one of its classes, then around another. Buckets whose members are then still in different
    components are compared across those components in chunks, so no link between different texts is lost to a bucket's size.
    """
    with small_batches(documents.sparkSession):
        prints, labels = _labelled(documents, id_col, text_col)
    rows = prints.select("id", "n_shingles", "cls").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("smallest"))
    return rows.join(smallest, "component", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("smallest", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("smallest", "id"), F.col("smallest").isNull()).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without all but one row of each group: that with the smallest id (null last), of equal ids the first row.

    Rows are told apart by a written key, as ids may repeat or be null. The keys of those that go are written too, and what they were
    found with can be emptied before the texts are read again; where few go, no text is shuffled.
    """
    place, spark = "__at", documents.sparkSession
    rows = keep(documents.withColumn(place, F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(place).alias("at"))
    start = mark(spark)
    found = near_duplicates(rows.select(key.alias("__key"), F.col(text_col)), "__key", text_col)
    stop = mark(spark)
    gone = keep(found.where("NOT kept").select(F.col("__key.at").alias(place)), "gone")
    release(spark, start, stop)
    return rows.join(gone, place, "left_anti").select(documents.columns)

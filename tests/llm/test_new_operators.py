"""Fill-in-middle, spelling variants and the n-gram join against plain Python."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
from test_operators import AWKWARD, KIND, SF, awkward, documents, nothing, rows_of  # noqa: E402, F401

from rasterecho.llm import fim, set_join, spelling  # noqa: E402
from rasterecho.llm.queries import QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# --- fill in middle --------------------------------------------------------------------------------


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(6)
    for n in (0, 1, 63, 64, 511, 512, 513, 3000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols)
        at = np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == [0, *np.cumsum(symbols == c).tolist()]


def test_cuts_of_one_slab():
    """Counts and every place of every text, texts side by side in one slab."""
    random.seed(9)
    texts = ["".join(random.choice("ab é€\U0001f600 \n\t") for _ in range(random.randint(0, 30))) for _ in range(300)] + ["", " ", "a", "\n\n", "é" * 700]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    cuts = fim.Cuts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    tokens = [brute.TOKEN.findall(t) for t in texts]
    assert cuts.counts.tolist() == list(map(len, tokens))
    for k in range(12):
        units = np.minimum(k, cuts.counts)
        at = cuts.place(units)
        want = ["".join(t[:k]) for t in tokens]
        assert (at - cuts.start).tolist() == [len(w.encode()) for w in want]
        assert cuts.code_points(cuts.start, at).tolist() == list(map(len, want))


NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_fill_in_middle(spark):
    rows = documents(spark)
    want = brute.fill_in_middle(rows)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert rows_of(QUERIES["op12_fill_in_middle"](spark, SF), *NAMES) == sorted(want, key=repr)


def test_fill_in_middle_edges(spark, awkward, nothing):  # noqa: F811
    texts = [*AWKWARD, "a <P> b", "<S>", "<M>x", "a <", "S> b <", "P", "<P", ">", "<<P", "a<b>c <S", "\U0001f600 é€  \n x ", "w " * 300_000]
    rows = [(i, t) for i in range(40) for t in texts[:-1]] + [(i, texts[-1]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = fim.transform(df).withColumn("restored", fim.restored())
    got = rows_of(made.selectExpr("doc_id", "n", "form", "prefix_chars", "middle_chars", "sha2(CAST(output AS BINARY), 256) AS output_sha256", "sha2(CAST(restored AS BINARY), 256) AS restored_sha256"), *NAMES)
    assert got == sorted(brute.fill_in_middle(rows), key=repr)
    clean = fim.transform(awkward)
    assert clean.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and clean.count() == awkward.count()
    assert clean.where("doc_id IS NULL").first().n == 8
    assert fim.transform(nothing).count() == 0


# --- spelling variants -----------------------------------------------------------------------------


def test_one_edit():
    random.seed(4)
    words = ["".join(random.choice("abé") for _ in range(random.randint(0, 6))) for _ in range(250)]
    for a in words:
        for b in words:
            assert spelling._one_edit(a, b) == brute.one_edit(a, b), (a, b)


def test_close_pairs():
    """Every near pair of two lists of words is found, letters that share a column and very long words included."""
    random.seed(5)
    words = {"".join(random.choice("abcÀÁÂÃÄÅÆÇÈÿ") for _ in range(random.randint(4, 7))) for _ in range(400)} | {"x" * 5000, "x" * 5001, "x" * 4999 + "y"}
    words |= {w[:2] + "z" + w[2:] for w in list(words)[:100]}
    words = sorted(words)
    want = {(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) < 2 and len(a) < 100 and brute.one_edit(a, b)}
    want |= {("x" * 5000, "x" * 5001), ("x" * 4999 + "y", "x" * 5000)[::-1], ("x" * 4999 + "y", "x" * 5001)}
    want = {(min(p), max(p)) for p in want if spelling._one_edit(*p)}
    assert spelling.close_pairs(words, words) == want


def test_spelling(spark):
    found = QUERIES["op13_spelling_variants"](spark, SF)
    counts = brute.vocabulary(documents(spark))
    want = brute.variants(counts)
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)
    assert rows_of(found, "word", "form", "root", "n", "n_near", "form_n") == sorted(want, key=repr)


@pytest.mark.parametrize(("chunk", "row"), [(3, 4), (512, 2048)])
def test_spelling_in_chunks(spark, monkeypatch, chunk, row):
    """A cell that holds most words is cut into many chunks, and no pair is lost; chains of forms are followed to their end."""
    monkeypatch.setattr(spelling, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(spelling, "ROW_WORDS", row)
    random.seed(7)
    n = {"".join(random.sample("abcdef", 6)): random.randint(3, 40) for _ in range(150)}
    n |= {w[:k] + w[k + 1 :]: random.randint(3, 9) for w in list(n)[:60] for k in (0, 5)} | {"abcdefg"[:k] + "t" * (12 - k): 3 * 2**k for k in range(8)}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert rows_of(spelling.variants(df), "word", "form", "root", "n", "n_near", "form_n") == sorted(brute.variants(n), key=repr)


def test_spelling_edges(spark, awkward, nothing):  # noqa: F811
    rows = [(i % 7, t) for i, t in enumerate([*AWKWARD * 4, "Überößer ÜBERößer überößer", "×÷×÷×x " * 5, "abcdeñ" * 4000, "Word-WORD_word " * 400] * 3)]
    rows += [(i, "longish" + "q" * 60 + " shortish " * 3) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == brute.vocabulary(rows)
    assert spelling.variants(spelling.vocabulary(nothing)).count() == 0
    assert spelling.variants(spelling.vocabulary(awkward)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.vocabulary(awkward.where("doc_id = 3")).count() == 0


# --- n-gram join -----------------------------------------------------------------------------------


def crowd():
    """A large group of near copies around the limit, chains, a passage that many share, copies, tiny and awkward texts."""
    random.seed(12)
    words = [f"w{i}" for i in range(3000)]
    base = random.choices(words, k=240)
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(random.randint(0, 5)):
            copy[random.randrange(240)] = random.choice(words)
        rows.append((1000 + i, " ".join(copy)))
    passage = random.choices(words, k=100)
    rows += [(2000 + i, " ".join(passage + random.choices(words, k=random.randint(0, 30)))) for i in range(80)]
    chain = random.choices(words, k=200)
    rows += [(3000 + i, " ".join(chain[4 * i : 4 * i + 120])) for i in range(20)]
    rows += [(4000 + i, rows[i % 7][1].upper()) for i in range(40)]
    rows += [(5000 + i, " ".join(random.choices("abc", k=random.randint(0, 14)))) for i in range(200)]
    return rows + [(6000 + i, t) for i, t in enumerate(AWKWARD)]


def links_of(rows):
    return sorted((r[:3] for r in brute.near_duplicates(rows, 3, 90)), key=repr)


def test_ngram_join(spark):
    rows = documents(spark)
    assert rows_of(QUERIES["op11_ngram_join"](spark, SF), "doc_id", "n_shingles", "component_id") == links_of(rows)


@pytest.mark.parametrize(("part", "common", "stars"), [(512, 50, 2), (3, 5, 1)])
def test_ngram_join_of_a_crowd(spark, monkeypatch, part, common, stars):
    """Also with few members to a part, many common shingles, and a single star, so that the blocks must find the rest."""
    monkeypatch.setattr(set_join, "PART", part)
    monkeypatch.setattr(set_join, "LEAST_COMMON", common)
    monkeypatch.setattr(set_join, "STARS", stars)
    rows = crowd()
    want = links_of(rows)
    assert len({r[2] for r in want}) < len(rows) - 150
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert rows_of(set_join.similar_sets(df), "doc_id", "n_shingles", "component_id") == want


def test_ngram_join_edges(spark, awkward, nothing):  # noqa: F811
    got = rows_of(set_join.similar_sets(awkward), "doc_id", "n_shingles", "component_id")
    assert len(got) == awkward.count()
    assert got.count((3, 1, 3)) == 3 and (0, 0, 0) in got and (1, 0, 1) in got and (6, 1, 6) in got
    assert set_join.similar_sets(nothing).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    for n in (1, 3, 9, 30, 300, 2000):
        for _ in range(40):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone = rng.random(len(x)) < rng.random() * 0.15
            y = np.unique(np.concatenate([x[~gone], rng.integers(0, 2**63, int(rng.integers(0, n // 10 + 2))).astype(np.uint64)]))
            if not len(y):
                continue
            a, b = set_join.bitmap(x), set_join.bitmap(y)
            least = min(len(a), len(b))
            bits = int(np.bitwise_count(set_join.fold(a, least) ^ set_join.fold(b, least)).sum())
            both = len(np.intersect1d(x, y))
            assert bits <= len(x) + len(y) - 2 * both
            links = 100 * both >= 90 * (len(x) + len(y) - both)
            assert links == bool(set_join.may_link(len(x), len(y), len(x) + len(y) - 2 * both))
            if links:
                assert len(np.intersect1d(x[: set_join.listed(len(x))], y[: set_join.listed(len(y))]))


def test_answers_are_derived():
    """Answers equal those counted afresh, and similar sets in a row look up only what differs."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    block = [np.unique(rng.choice(pool, 300)) for _ in range(20)]
    answers, base = set_join.Answers(block), np.unique(rng.choice(pool, 500))
    asked = 0
    for i in range(30):
        s = np.sort(np.delete(base, [i, i + 40])) if i != 15 else np.unique(rng.choice(pool, 100))
        asked += len(s)
        assert answers(s).tolist() == [len(np.intersect1d(s, b)) for b in block]
    assert answers.looked_up < asked / 4

"""The operators against plain Python on the smallest tables and on rows made to be awkward."""

from __future__ import annotations

import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from rasterecho.llm import decontaminate, html_text, lang_id, license_scan, mixing, near_dup, pii, quality, token_file, url_filter  # noqa: E402
from rasterecho.llm.queries import ORACLES, QUERIES  # noqa: E402
from rasterecho.llm.tokenizers import word_tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, cls string, id string, key string"
AWKWARD = [None, "", " \n\t", "one", "one two three four", "A b C d E f", "x " * 5000, "ß" * 3000, "a.b@c.de " * 400, "1" * 20000, "  ́x", "line\nline\nline"]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, ties, repeated rows, a very long text, and columns whose names clash with inner ones."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 1, "c", "i", "k") for i, t in enumerate(AWKWARD)]
    rows += [(3, "one", "en", "s", 1, "c", "i", "k")] * 2 + [(None, "no id here at all in this row", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for name in ("documents", "pages"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        cursor = base.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df, *names) == sorted(cursor.fetchall(), key=repr), name


def test_language(spark):
    found = QUERIES["op1_language_id"](spark, SF)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in found.collect() if r.held_out]
    assert held and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)


def test_code_lengths_are_exact():
    """The table's lengths against a walk down the context tree with method C's escapes."""
    text = b"abracadabra abracadabra"
    codes = np.arange(256, dtype=np.uint8)
    symbols, packed = lang_id._contexts(np.frombuffer(text, np.uint8), np.array([0, len(text)]), codes)
    grams, n = np.unique(packed.astype(np.int64) << 8 | symbols, return_counts=True)
    model = lang_id.Model([("x", int(g), int(c)) for g, c in zip(grams, n, strict=True)])
    counts: dict = {}
    padded = bytes(3) + text
    for i in range(len(text)):
        for k in range(4):
            own = counts.setdefault(padded[i + 3 - k : i + 3], {})
            own[padded[i + 3]] = own.get(padded[i + 3], 0) + 1

    def bits(context, byte):
        own = counts.get(context)
        shorter = lambda: bits(context[1:], byte) if context else 8.0
        if not own:
            return shorter()
        total = sum(own.values()) + len(own)
        return -np.log2(own[byte] / total) if byte in own else -np.log2(len(own) / total) + shorter()

    probe = b"abra bar cab"
    padded = bytes(3) + probe
    want = sum(bits(padded[i : i + 3], padded[i + 3]) for i in range(len(probe)))
    assert model.bits_of(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0, 0] == pytest.approx(want, rel=1e-5)


def test_quality(spark, awkward, nothing):
    def measure(text):
        words = brute.WORD.findall(text or "")
        runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = [False] * len(words)
        for i, r in enumerate(runs):
            if runs.count(r) > 1 if len(runs) < 3000 else True:
                hit[i : i + 8] = [True] * 8
        lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
        n, r = len(words), sum(hit)
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (awkward, spark.read.parquet(f"{SF}/documents.parquet")):
        want = sorted(((r.doc_id, *measure(r.text)) for r in df.collect()), key=repr)
        assert rows_of(quality.judge(df), "doc_id", *names) == want
    assert quality.judge(nothing).count() == 0


def test_main_text(spark):
    found = {r.page_id: r for r in QUERIES["op3_main_text"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        import html

        assert found[r.page_id].text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert found[r.page_id].n_chars == len(found[r.page_id].text)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p>hi", "hi"), ("<div", ""), ("plain words", "plain words"),
    ("<div id=content><h2>T</h2><p>One two three four five.</p><div class=ad>Buy</div><p>Last.</p></div><div class=comments><p>Nice post of you.</p></div>", "T One two three four five. Last."),
    ("<body><header><h1>Site</h1></header><div><p>Words and more words here.</p></div><footer>f</footer></body>", "Words and more words here."),
    ("<article><header><h1>T&eacute;</h1></header><p>a &amp; b<script>x('<p>')</script></p><!-- <p>no</p> --></article>", "Té a & b"),
])
def test_pages_by_hand(page, text):
    assert html_text.main_text(page, html_text.Weights()) == text


BODY = "".join(f"<p>The water rose in the night and people of the town number {i} left for the hills above it.</p>" for i in range(4))
PLAIN = " ".join(f"The water rose in the night and people of the town number {i} left for the hills above it." for i in range(4))


@pytest.mark.parametrize("attributes", ['class="content has-sidebar"', 'class="layout no-sidebar"', 'class="post comments-open"', 'id="search-results"', 'class="overflow-hidden"', 'aria-hidden="false"', 'class="page sidebar"', "id=social"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_wrappers_keep_their_text(attributes, inner):
    """A layout class, or a name that turns out wrong, does not take the text of a page with it."""
    page = f"<body><nav><a>Home</a></nav><div {attributes}>{inner.format(BODY + '<div class=ad>Buy now</div>')}</div><footer>f</footer></body>"
    assert html_text.main_text(page, html_text.Weights()) == PLAIN


@pytest.mark.parametrize("beside", [
    "<div hidden>" + BODY + "</div>", "<div style='color:red; display: none'>" + BODY + "</div>", "<aside>" + BODY * 5 + "</aside>",
    "<div class=comment-list><article><p>Nice post of you, and all of it is true.</p></article></div>", "<div class='x comments'>" + BODY * 9 + "</div>", "<div class=nav-menu><p>One two three.</p></div>",
])
def test_beside_the_text_stays_out(beside):
    for page in (f"<div><article>{BODY}</article>{beside}</div>", f"<form id=f><main>{BODY}{beside}</main></form>", f"<div class=sidebar><article>{BODY}</article>{beside}</div>"):
        assert html_text.main_text(page, html_text.Weights()) == PLAIN


@pytest.mark.parametrize("name", [
    "reader-comments", "user-comments", "comment-body", "google-ad", "gdpr-notice", "left-sidebar", "page-footer", "global-nav", "commentlist", "disqus_thread", "adsbygoogle",
    "comment-list", "x comments", "mainMenu", "ad",
])
def test_named_blocks_inside_the_text_stay_out(name):
    page = f"<body><nav><a>Home</a></nav><article>{BODY}<div class='{name}'><p>Nice post of you.</p></div></article></body>"
    assert html_text.main_text(page, html_text.Weights()) == PLAIN


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "comments-open", "search-results", "overflow-hidden", "adapted", "navy", "shared", "padding", "loading-text"])
def test_layout_words_name_no_boilerplate(name):
    page = f"<article>{BODY}<div class='{name}'><p>One more line of the text.</p></div></article>"
    assert html_text.main_text(page, html_text.Weights()) == f"{PLAIN} One more line of the text."


def test_pages_take_linear_time():
    import time

    started = time.process_time()
    for page in ("<b>x" * 60_000, "<b>" * 60_000 + "</i>" * 60_000, "<i>" + "<b>x</q>" * 60_000):
        html_text.main_text(page, html_text.Weights())
    assert time.process_time() - started < 20
    assert html_text.main_text("<p>super<wbr>cali is one word here</p>", html_text.Weights()) == "supercali is one word here"


def test_best_region():
    assert html_text.best_region([-1, 2, -1, 3, -5, 4]) == (1, 4)
    assert html_text.best_region([-1.0]) == (0, 0)


def test_personal_data_patterns():
    random.seed(5)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for _ in range(3000):
        text = "".join(random.choice("ab@@..1234+ -()é") for _ in range(random.randint(0, 60)))
        if random.random() < 0.3:
            text += random.choice(["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (377) 555-7427", "x.y@a.b.c"])
        want = {
            "email": [m.span() for m in email.finditer(text)], "ip": [m.span() for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
            "card": [m.span() for m in card.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))], "phone": [m.span() for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15],
        }
        assert pii.patterns(text) == want, text


def test_personal_data_field(spark, awkward, nothing):
    field = pii.Field()
    for text, span in (("please call (499) 555-0123 today", "(499) 555-0123"), ("bob(at)mail.example.org ok", "bob(at)mail.example.org"), ("version 2.0. of 1998", None)):
        got = [text[a:z] for words, spans in pii.runs_of(text) for y in field.decode([words]) for _, a, z in pii._added(text, spans, y, [])]
        assert got == ([span] if span else [])
    assert pii.find_personal_data(awkward).count() == awkward.count()
    assert pii.find_personal_data(nothing).count() == 0


def test_url_list(spark):
    captures = spark.createDataFrame([(1, "http://a.b.c/x", 5), (2, "http://a.b.c/x", 9), (3, "https://B.C:80", 5), (4, None, 5), (5, "nohost", 5), (6, "http://b.c.d/", 5), (7, "http://b.c/", None)], "page_id int, url string, day int")
    entries = spark.createDataFrame([("b.c", "spam", 3, "add"), ("b.c", "spam", 7, "remove"), ("a.b.c", "bad", 8, "add")], "pattern string, category string, day int, action string")
    got = {r.page_id: (r.n_active, r.category, r.blocked) for r in url_filter.apply_list(captures, entries).collect()}
    assert got == {1: (1, "spam", True), 2: (1, "bad", True), 3: (1, "spam", True), 4: (0, None, False), 5: (0, None, False), 6: (0, None, False), 7: (0, None, False)}
    assert url_filter.apply_list(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filter.apply_list(captures.limit(0), entries).count() == 0


def test_hosts_of_urls(spark):
    """User info, ports, final dots and letters of any case do not hide a host; clashing columns stay, repeated captures too."""
    hidden = ["http://user:pw@bad.com/", "http://user@bad.com/", "http://bad.com./x", "HTTP://BAD.com:8080?q", "ftp://a@b@www.Bad.Com.:21#f", "http://bad.com"]
    clear = ["http://bad.com@good.org/", "http://notbad.com/", "http://bad.com.org/", "mailto:x@bad.com", "http://:80/", "http:///bad.com", "//bad.com/"]
    rows = [(i, u, 5, "n", "s", "h") for i, u in enumerate([*hidden, *clear])] * 2
    captures = spark.createDataFrame(rows, "page_id int, url string, day int, now string, spans string, host string")
    entries = spark.createDataFrame([("BAD.com", "spam", 1, "add")], "pattern string, category string, day int, action string")
    found = url_filter.apply_list(captures, entries)
    assert {"now", "spans", "page_id", "url", "day", "host", "n_active", "category", "blocked"} == set(found.columns)
    got = sorted((r.page_id, r.blocked, r.now) for r in found.collect())
    assert got == sorted([(i, i < len(hidden), "n") for i in range(len(hidden) + len(clear))] * 2)


def test_licenses(spark, awkward, nothing):
    texts = [f"{'word ' * n}{t} {'more ' * n}" for n in (0, 1, 7, 200) for _, t in license_scan.TEMPLATES] + ["nothing here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.license) for r in license_scan.scan(df, license_scan.templates(spark)).collect()}
    want = {(i, license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)][0]) for i in range(len(texts) - 2)}
    assert want <= got
    assert license_scan.scan(awkward, license_scan.templates(spark)).count() == license_scan.scan(nothing, license_scan.templates(spark)).count() == 0


def test_license_needs_the_whole_template(spark):
    """Part of a template is no license, wherever it is cut; a long template counts only with its span; no short tail matches alone."""
    long = " ".join(f"l{i}" for i in range(53))
    tail = " ".join(f"t{i}" for i in range(13))
    known = spark.createDataFrame([*license_scan.TEMPLATES, ("long", long), ("tail", tail)], "license string, text string")
    halves = [f"some {' '.join(w[a:z])} more" for _, t in (*license_scan.TEMPLATES, ("long", long), ("tail", tail)) if len(w := t.split()) > 9 for a, z in ((0, len(w) // 2 + 1), (len(w) // 2 - 1, len(w)))]
    halves += ["under the Mozilla Public License, v 2.0", "t10 t11 t12", f"{' '.join(long.split()[:27])} {'x ' * 400}{' '.join(long.split()[26:])}"]
    texts = halves + [f"{'y ' * n}{t}{' z' * n}" for n in range(40) for t in (tail, long)] + [long.replace("l20", "x").replace("l40", "x x x")]
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), known).collect()}
    want = {(len(halves) + 2 * i + j, ("tail", "long")[j]): 1.0 for i in range(40) for j in (0, 1)} | {(len(texts) - 1, "long"): 45 / 51}
    assert got == want


def test_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 8, 511, 512, 513, 5000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 33, n)).astype(np.uint32) if n else np.zeros(0, np.uint32)
        codes = token_file.Codes(token_file.encode(ids))
        assert (codes.at(np.arange(n)) == ids).all()
        if n:
            places = rng.integers(0, n, 300)
            assert (codes.at(places) == ids[places]).all()
            for a, z in [(0, n), (n - 1, n), *(sorted(rng.integers(0, n + 1, 2).tolist()) for _ in range(30))]:
                assert (codes.run(a, z) == ids[a:z]).all()


def test_tokens(spark, awkward, nothing):
    for rows in (documents(spark), [(i, t) for i, t in enumerate(AWKWARD)]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        segments = token_file.write_tokens(df, word_tokenizer())
        assert rows_of(token_file.read_documents(segments), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.tokens(rows, word_tokenizer()), key=repr)
    total = segments.agg(F.sum("n_tokens")).first()[0]
    assert token_file.tokens_at(segments, spark.createDataFrame([(0,), (total - 1,)], "place bigint")).count() == 2
    assert token_file.read_documents(token_file.write_tokens(awkward, word_tokenizer())).count() == awkward.count()
    assert token_file.read_documents(token_file.write_tokens(nothing, word_tokenizer())).count() == 0


def test_near_duplicates(spark, awkward, nothing):
    random.seed(2)
    words = [f"w{i}" for i in range(4000)]
    rows = documents(spark)
    base = [random.choice(words) for _ in range(300)]
    passage = random.choices(words, k=60)
    for i in range(120):  # one large group of near copies
        copy = list(base)
        for _ in range(2):
            copy[random.randrange(300)] = random.choice(words)
        rows.append((10_000 + i, " ".join(copy)))
    rows += [(11_000 + i, " ".join(passage + random.choices(words, k=120))) for i in range(120)]  # a shared passage links nothing
    rows += [(12_000 + i, t) for i, t in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(near_dup.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(rows), key=repr)
    assert near_dup.near_duplicates(awkward).count() == awkward.count()
    assert near_dup.near_duplicates(nothing).count() == 0
    kept = near_dup.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.where("text = 'one'").count() == 1


def test_one_row_of_each_group(spark):
    """Rows that share an id, or have none, are kept or dropped each for its own text."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"}
    rows = [
        (7, text["a"]), (7, text["b"]),  # one id, two clean documents
        (1, text["c"]), (8, text["c"] + " x"), (8, text["d"]),  # one of id 8 is a near copy of id 1, the other is clean
        (None, text["e"]), (None, text["e"] + " x"), (None, text["e"]),  # a group without any id
        (None, text["d"]), (None, text["f"]), (9, text["f"] + " x"), (5, ""), (5, ""), (None, None),
    ]
    got = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    want = [(7, text["a"]), (7, text["b"]), (1, text["c"]), (8, text["d"]), (9, text["f"] + " x"), (5, ""), (5, ""), (None, None)]
    of_e = [r for r in got if (r.text or "").startswith("e0 ")]
    assert len(of_e) == 1 and of_e[0].doc_id is None
    assert sorted((tuple(r) for r in got if r not in of_e), key=repr) == sorted(want, key=repr)


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"x", b"y"), (b"z", b"z")]
    got = {r.cls: r.component for r in near_dup.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert len({got[bytes([i])] for i in range(61)}) == 1 and got[b"x"] == got[b"y"] != got[bytes([1])]


@pytest.mark.parametrize("chunk", [2, 512])
def test_rest_of_buckets(spark, monkeypatch, chunk):
    """Members that no star brought together are still compared with each other, in one chunk or in several."""
    monkeypatch.setattr(near_dup, "CHUNK", chunk)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[:-3]), " ".join(words[:-20]), " ".join(words[100:] + words[:70]), "a b c d e f", " ".join(words[:120])]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    classes = documents.mapInArrow(near_dup._fingerprints, "id int, n_shingles bigint, cls binary, bands array<bigint>, signature binary")
    cls = {r.id: bytes(r.cls) for r in classes.collect()}
    members = classes.selectExpr("7L AS key", "cls")
    labels = spark.createDataFrame([(cls[1], cls[0]), (cls[0], cls[0])], "cls binary, component binary")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = {(i, j) for i in range(6) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    want = alike - {(1, 0)}  # of one component already
    assert len(want) == 4
    got = near_dup._rest(members, labels, classes, documents, "doc_id", "text").collect()
    assert {(bytes(r.a), bytes(r.b)) for r in got} == {(min(cls[i], cls[j]), max(cls[i], cls[j])) for i, j in want}


def test_common_counts(monkeypatch):
    monkeypatch.setattr(near_dup, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    x, y = ([np.unique(rng.integers(0, 90, n)).astype(np.uint64) for n in sizes] for sizes in ((40, 1, 25), (60, 8)))
    assert near_dup._common(x, y).tolist() == [[len(set(map(int, p)) & set(map(int, q))) for q in y] for p in x]
    assert near_dup._common(x[:1], [np.array([1000], np.uint64)]).tolist() == [[0]]


def test_mix(spark, awkward, nothing):
    found = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))
    assert found.where("taken > 2 * size").count() == 0
    off = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").join(found, "doc_id").groupBy("source").agg((F.sum("taken") - F.first("target")).alias("off")).where("abs(off) > 1")
    assert off.count() == 0
    assert mixing.mix(awkward).count() == awkward.count()
    assert mixing.mix(nothing).count() == 0
    assert mixing.take(awkward).columns == awkward.columns


def test_mix_is_interleaved(spark, awkward):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 100).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    rows = mixing.take(docs, slot_col="slot").select("source", "slot").collect()
    target = {"0": 600_000, "1": 500_000, "2": 250_000}
    for n in (100, 400, 900, 1200):
        for source, words in target.items():
            assert abs(100 * sum(r.source == source and r.slot < n for r in rows) - n * 1024 * words / 1_350_000) <= 5 * 1024
    found = mixing.mix(docs).collect()
    assert all((r.slot is None) == (r.taken == 0) and (r.slot_again is None) == (r.taken <= r["size"]) for r in found if r.taken % 100 == 0)
    assert all(r.slot < r.slot_again for r in found if r.slot_again is not None)
    held = mixing.take(awkward, slot_col="N_chars")
    assert held.columns == [*(c for c in awkward.columns if c != "n_chars"), "N_chars"]
    assert held.count() == mixing.take(awkward).count() and held.where("N_chars IS NULL").count() == 0


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([("a", 1, 9, 1, 500_000.0, 1.0), ("b", 2, 9, 1, 250_000.0, 1.0), ("c", 3, 9, 1, 250_000.0, 1.0)], "key string, number int, source_size bigint, n bigint, target double, wanted double")
    slots = [r.number for r in mixing.schedule(sources).orderBy("slot").collect()]
    for n in (50, 200, 400, 800):
        assert abs(slots[:n].count(1) - n / 2) <= 4


def test_suffix_array_and_index():
    random.seed(3)
    for _ in range(150):
        text = np.array([0, *(random.choices([0, 1, 1, 2, 3], k=random.randint(0, 60))), 0], np.int32)
        order = decontaminate.suffix_array(text, 2)
        key = lambda i: [(0, j) if text[j] == 0 else (1, text[j]) for j in range(i, len(text))]  # noqa: B023, E731
        assert order.tolist() == sorted(range(len(text)), key=key)
        index = decontaminate.FMIndex(text, 3)
        phrases = [random.choices([1, 2, 3], k=random.randint(1, 4)) for _ in range(10)]
        table = np.array([[0] * (4 - len(p)) + p for p in phrases], np.int32)
        low, high = index.search(table, np.array([len(p) for p in phrases]))
        for p, a, z in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def test_decontaminate(spark, awkward, nothing, monkeypatch):
    rows = documents(spark) + [(10_000 + i, t) for i, t in enumerate(AWKWARD)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "one two"), (901, None), (902, "!"), (903, "one two"), (904, "x x x x x x x x x x x x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(brute.decontaminate(rows, items), key=repr)
    assert rows_of(decontaminate.digest(decontaminate.find_benchmark(docs, bench)), *names) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)  # several passes
    assert rows_of(decontaminate.digest(decontaminate.find_benchmark(docs, bench)), *names) == want
    assert decontaminate.find_benchmark(awkward, bench).count() == awkward.count()
    assert decontaminate.find_benchmark(nothing, bench).count() == 0
    assert decontaminate.find_benchmark(awkward, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.decontaminate(awkward, bench).columns == awkward.columns


def test_language_edges(spark, awkward, nothing):
    model = lang_id.train(awkward)
    got = [r for r in lang_id.identify(awkward, model).collect() if r.doc_id in (0, 1, 2, 9)]
    assert {r.lang_pred for r in got} == {"und"}
    assert {r.lang_pred for r in lang_id.identify(awkward, lang_id.train(nothing)).collect()} == {"und"}
    assert lang_id.identify(nothing, model).count() == 0


def test_languages_of_long_documents(spark):
    """A language whose documents are all long is learned, from excerpts; a document of its own length is told by it."""
    random.seed(8)
    letters = {"short": "abcdefg", "long": "opqrstu"}
    make = lambda lang, n: "".join(random.choice(letters[lang] + " ") for _ in range(n))
    rows = [(i, make("short", 500), "short") for i in range(5)] + [(10 + i, make("long", lang_id.SAMPLE_CHARS + 1 + 4000 * i), "long") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lang_id.train(df)
    assert model.langs == ["long", "short"]
    assert {r.doc_id: r.lang_pred for r in lang_id.identify(df, model).collect()} == {i: lang for i, _, lang in rows}


def test_language_table_is_bounded(monkeypatch):
    """Every order is cut when it must be, and what is left is said."""
    rng = np.random.default_rng(3)
    rows = [(f"l{x}", int(g), 1) for x in range(3) for g in np.unique(rng.integers(97, 117, (3000, 4)) @ (256 ** np.arange(4)))]
    whole = lang_id.Model(rows)
    assert whole.kept[0] == (1, 1) and all(n == of for n, of in whole.kept)
    row = 4 * whole.width * 3
    for rooms, kept in ((10, [1, 9, 0, 0]), (100, [1, 20, 79, 0]), (500, [1, 20, 400, 79])):
        monkeypatch.setattr(lang_id, "TABLE_BYTES", rooms * row)
        monkeypatch.setattr(lang_id, "LANGUAGE_BYTES", 0)
        model = lang_id.Model(rows)
        assert model.table.nbytes <= rooms * row and [n for n, _ in model.kept] == kept
        data = np.frombuffer(b"abcdefgh", np.uint8)
        assert np.isfinite(model.bits_of(data, np.array([0, 8]))).all()
    monkeypatch.setattr(lang_id, "LANGUAGE_BYTES", 200 * row)
    assert lang_id.Model(rows).table.nbytes == 600 * row


def test_pipeline(spark):
    """Each stage on its own input, by plain Python where its decision can be stated so."""
    import corpus_pipeline as P

    docs = P.table(spark, SF, "documents")
    for name, stage in P.STAGES:
        out = P.keep(stage(spark, docs, SF), name)
        before = [(r.doc_id, r.text) for r in docs.collect()]
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "near_duplicates":
            assert ids == sorted(d for d, _, _, kept in brute.near_duplicates(before) if kept)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in P.table(spark, SF, "benchmark").collect()]
            assert ids == sorted(r[0] for r in brute.decontaminate(before, items) if not r[-1])
        elif name == "mixture":
            sizes = {d: len(brute.WORD.findall(t or "")) for d, t in before}
            assert abs(sum(sizes[i] for i in ids) / sum(sizes.values()) - 1.5) < 0.1 and max(map(ids.count, ids)) <= 2
        elif name == "token_output":
            assert rows_of(out, "start", "n_tokens", "ids_crc32") == sorted((r[1:] for r in brute.tokens(before, word_tokenizer())), key=repr)
        if name != "token_output":
            assert out.columns == docs.columns
        docs = out

"""Rows that tables may hold: nulls in any column, repeats, very long and hostile texts, nothing; and generated code."""

import hashlib
import random
import time

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomlens.llm import bpe, decontaminate, html_extract, html_tree, line_dedup, minhash, pii, quality, substring_dedup, suffix_dedup, token_store
from loomlens.llm import queries as llm
from loomlens.llm.common import new_path

R = random.Random(8)
LONG = " ".join(f"w{i}" for i in range(70))
#: Null ids, repeated rows, one id with several texts, null texts.
ROWS = [(1, LONG), (1, LONG), (2, LONG + " x"), (2, "other text of two"), (None, LONG), (None, None), (None, "lone"), (3, None), (3, None), (-4, LONG[:60]), (7, LONG[:60] + LONG), (9, ""), (-(1 << 62), "lone"), (8, LONG)]
CLASH = [f"'clash' AS `{c}`" for c in ("doc", "lost", "kept", "h", "row", "rank", "label", "band", "no", "n", "chunk", "key", "start", "item", "k", "w", "gang", "rep", "component", "spans", "set_key")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).selectExpr("*", *CLASH)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_suffix_and_substring_dedup_of_odd_rows(docs):
    got = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, s) -> a + s[1] - s[0])").alias("n"), F.size("spans").cast("long").alias("m"), F.sha2("kept", 256).alias("sha"))
    assert rows(got, "doc_id", "n_bytes", "n", "m", "sha") == sorted(brute.suffix(ROWS), key=repr)
    got = substring_dedup.substring_dedup(docs).withColumn("sha", F.sha2("text", 256))
    assert rows(got, "doc_id", "n_words", "n_removed", "sha") == sorted(brute.substring(ROWS), key=repr)


def test_near_duplicates_of_odd_rows(docs):
    known = [(d, t) for d, t in ROWS if d is not None]
    want = brute.near(known) + [(None, len(brute.shingles(t)), None, True) for d, t in ROWS if d is None]
    assert rows(minhash.near_duplicates(docs, width=2), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_tokens_of_odd_rows(spark, docs):
    enc = bpe.load(bpe.default_path())
    assert rows(bpe.bpe_round_trip(docs), "doc_id", "ids", "decoded") == sorted([(d, enc.encode_ordinary(t or ""), t or "") for d, t in ROWS], key=repr)
    digest = lambda t: bpe.digests(enc.encode_ordinary(t), t.encode())
    got = bpe.map_tokens(docs, bpe.digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    assert rows(got, *got.columns) == sorted([(d, *digest(t or "")) for d, t in ROWS], key=repr)
    path = new_path(spark, "store")
    token_store.write_store(docs, path)
    t = token_store.encoder(token_store.default_path()).tokenizer
    want = [x[2:] for x in brute.store([(0, t) for _, t in ROWS], t)]
    got = token_store.read_store(token_store.open_store(spark, path))
    assert [r[1:] for r in rows(got, "key", "n_tokens", "ids_crc32")] and sorted(r[1:] for r in rows(got, "key", "n_tokens", "ids_crc32")) == sorted(want)


def test_decontamination_of_odd_rows(spark, docs):
    items = [(1, LONG), (1, LONG), (None, LONG), (2, None)]
    d = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *[c for c in CLASH if "`item`" not in c])
    got = rows(decontaminate.decontaminate(docs, d), "doc_id", "item_id")
    assert got == sorted({(d, i) for d, t in ROWS for i in (1,) if t and LONG in t}, key=repr)


def test_ids_that_are_no_integers_are_refused(docs):
    d = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    for f in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup, minhash.near_duplicates):
        with pytest.raises(TypeError):
            f(d)
    assert quality.quality_rules(d).count() == line_dedup.line_dedup(d).count() == bpe.bpe_round_trip(d).count() == len(ROWS)


def test_stages_of_odd_rows_and_of_nothing(spark, tmp_path):
    spark.createDataFrame([(1, LONG)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("kept", "lost", "doc", "gone", "leaky")})
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, str(tmp_path))
        assert got.columns == list(corpus_pipeline.COLUMNS) or "n_tokens" in got.columns
        n = got.count()
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0 <= n
    near = rows(corpus_pipeline.near_dup_stage(spark, d, str(tmp_path)), "doc_id")
    assert (-4,) in near and not {(2,), (8,)} & set(near) and near.count((None,)) == 3


def test_nothing(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    assert decontaminate.decontaminate(none, items).count() == decontaminate.decontaminate(docs, items.limit(0)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.html_extract(pages).count() == 0


HOSTILE = {
    "letters": "A" * 1_000_000, "dots": "a." * 500_000, "numbers": "1234 " * 100_000, "secret": "token=" + "A1" * 500_000, "hosts": "a@b.1" * 200_000, "blanks": " " * 1_000_000,
    "lines": "A line that is long enough to be counted, and is everywhere\n" * 20_000, "words": "b " * 300_000,
}


def test_personal_data_in_long_texts_takes_linear_time():
    for name, text in HOSTILE.items():
        began = time.process_time()
        pii.pseudonymise(text, "k")
        assert time.process_time() - began < 10, name


def test_pages_take_linear_time():
    for page in ("<span>" * 40_000 + "</b>" * 40_000, "<span>" * 40_000 + "<hr>" * 40_000, '<p class="x>' * 40_000, "<span>" * 40_000 + "<li>x" * 40_000, "<" * 500_000, "<a ='" * 100_000):
        began = time.process_time()
        html_tree.parse(page)
        assert time.process_time() - began < 5


def test_operators_on_long_texts(spark):
    data = [(i, t) for i, t in enumerate(HOSTILE.values())] + [(100 + i, HOSTILE["lines"] + str(i)) for i in range(5)]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = {i: len(t.encode()) for i, t in data}
    assert {r[0]: r[1] for r in rows(suffix_dedup.suffix_dedup(d), "doc_id", "n_bytes")} == want
    assert len(rows(minhash.near_duplicates(d), "doc_id")) == len(data)
    got = {r[0]: r[1:] for r in rows(line_dedup.line_dedup(d), "doc_id", "n_lines", "n_dropped")}
    assert got[100] == (20_001, 20_000) and got[104] == (20_001, 0)
    assert {r[0]: r[1] for r in rows(quality.quality_rules(d), "doc_id", "n_words")}[7] == 300_000
    path = new_path(spark, "long")
    token_store.write_store(d, path)
    assert token_store.read_store(token_store.open_store(spark, path)).count() == len(data)
    assert dict(rows(bpe.map_tokens(d, bpe.digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"), "doc_id", "decoded_sha256")) == {i: brute.sha(t) for i, t in data}


def test_generated_code_gives_the_same(spark):
    """Other tests run without generated code; the native operators must not depend on that."""
    d = "/root/testdata/sf0.001"
    ask = lambda: [rows(f, *f.columns) for f in (*(llm.QUERIES[q](spark, d) for q in ("op1_benchmark_decontamination", "op4_quality_rules", "op10_line_dedup")), quality.quality_rules(spark.read.parquet(f"{d}/documents.parquet"), keep=("text", "lang")).where("kept").select("doc_id", "text", "lang"))]
    plain = ask()
    settings = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert ask() == plain and all(plain)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_what_is_written_can_be_released(spark, docs, tmp_path, monkeypatch):
    import os

    from loomlens.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(common, "_WRITTEN", [])
    n = substring_dedup.substring_dedup(docs).count() + minhash.near_duplicates(docs).count()
    assert n == 2 * len(ROWS) and os.listdir(tmp_path) and not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]
    assert common.release(spark) > 0 and os.listdir(tmp_path) == [] == common._WRITTEN


# --- personal data against plain Python


def feistel(value, radix, n, key):
    """The network again, from its description: alternating halves of the digits, ten rounds of keyed blake2b."""
    mix = lambda i, x, most: int.from_bytes(hashlib.blake2b(f"{i}|{radix}|{n}|{x}".encode(), key=key, digest_size=max(16, most // 8 + 9)).digest(), "big")
    if n == 1:
        return (value + mix(0, 0, 8)) % radix
    right = n // 2
    a, b = value // radix**right, value % radix**right
    for i in range(10):
        if i % 2:
            b = (b + mix(i, a, (radix**right).bit_length())) % radix**right
        else:
            a = (a + mix(i, b, (radix ** (n - right)).bit_length())) % radix ** (n - right)
    return a * radix**right + b


def kind_key(kind):
    return hashlib.blake2b(f"{pii.QUERY_KEY}|{kind}".encode(), digest_size=32).digest()


def luhn(digits):
    twice = [int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(digits[::-1])]
    return sum(twice) % 10 == 0


def fill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def test_pseudonyms_of_the_query_against_plain_python(spark, tmp_path):
    """A fixture whose values are known: the query must find these, replace them as the network says, and leave the rest."""
    r, data, want = random.Random(3), [], []
    for i in range(40):
        text, spans, new = "", [], ""
        for _ in range(r.randint(0, 6)):
            gap = ", " + " ".join(r.choice(("word", "und", "é", "12", "3.4", "x-1", "v1.2", "2024-13-01", "4111 1111 1111 1112", "999.1.1.1")) + "," for _ in range(r.randint(1, 3))) + " "
            kind = r.choice(("ssn", "card", "phone"))
            if kind == "ssn":
                old = f"{r.randint(100, 600):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
                value = old
                while True:
                    value = fill(old, f"{feistel(int(value.replace('-', '')), 10, 9, kind_key(kind)):09d}")
                    if value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000":
                        break
            elif kind == "card":
                body = "4" + "".join(r.choice("0123456789") for _ in range(14))
                body += next(c for c in "0123456789" if luhn(body + c))
                old = f"{body[:4]} {body[4:8]} {body[8:12]} {body[12:]}"
                digits = f"{feistel(int(body[:-1]), 10, 15, kind_key(kind)):015d}"
                value = fill(old, digits + next(c for c in "0123456789" if luhn(digits + c)))
            else:
                old = f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
                value = fill(old, f"{feistel(int(''.join(c for c in old if c.isdigit())), 10, 10, kind_key(kind)):010d}")
            spans.append((kind, len(text + gap), len(text + gap + old)))
            text, new = text + gap + old, new + gap + value
        data.append((i, text + ", end"))
        want.append((i, new + ", end", len(spans), spans))
    spark.createDataFrame([*data, (99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["text"], r["n_found"], [tuple(x) for x in r["spans"]]) for r in llm.QUERIES["op7_pii_pseudonyms"](spark, str(tmp_path)).where("doc_id < 99").collect())
    assert got == want


def test_no_pseudonyms_without_a_key(spark, docs):
    with pytest.raises(ValueError, match="secret key"):
        pii.pii(docs)
    spark.conf.set(pii.KEY_CONF, "from the session")
    try:
        assert pii.pii(docs).count() == len(ROWS)
    finally:
        spark.conf.unset(pii.KEY_CONF)


# --- pages labelled by hand

NEWS = """<!doctype html><html lang=en><head><meta charset=utf-8><title>River crossing closed</title><script>var a = "<p>no</p>";</script></head>
<body class="home"><header class="site-header"><a href="/">The Gazette</a><nav><ul><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></nav></header>
<div id="cookie-banner"><p>We use cookies to improve your experience on this site.</p><button>Accept</button></div>
<main><article class="post"><h1>River crossing closed after flood</h1>
<p>The old bridge at Ferry Lane was closed on Tuesday evening after the river rose by almost two metres, the council said.</p>
<p>Engineers will inspect the piers &amp; the deck before it opens again; drivers should use the ring road.</p>
<div class="ad"><p>Buy two winter tyres today and get the third for free!</p></div>
<ul><li>Bus line 4 ends at the market.</li><li>Cyclists may use the weir.</li></ul>
<p>A spokesperson said that the work might take until <b>Friday</b>.</p></article></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Ten quick soups</a></li><li><a href=/2>Who won the cup?</a></li></ul></aside>
<section id="comments"><h2>2 comments</h2><div class="comment"><b>Ann</b><p>I waited there for an hour, nobody told us anything.</p></div></section>
<footer><p>&copy; 2024 The Gazette. All rights reserved.</p></footer></body></html>"""
BLOG = """<html><body><div class="navbar"><a href="/">Home</a> | <a href="/about">About</a></div>
<div class="entry-content"><h2>How I repaired a radio</h2><p>It was silent when I got it, and the dial lamp was dead as well.
<p>First I replaced the two large capacitors, which had leaked over the years.<br>Then I cleaned the switch.
<blockquote>Never touch the chassis while it is plugged in.</blockquote>
<p>After an evening of work it plays again, if a little quietly.</div>
<form class="newsletter"><label>Subscribe to our letter</label><input name=mail></form>
<div class="related-posts"><h4>Related</h4><a href=/a>A clock</a><a href=/b>A lamp</a></div></body></html>"""
BROKEN = """<div id=content><h1>Notes on bread</h1><p class="lead>The dough rests for a night in a cold room, covered with a damp cloth.</p>
<p>In the morning it is shaped, rested again for an hour, and baked in a hot oven.</p><p>Let it cool before you cut it, however hard that may be.</p></div><footer>Imprint</footer>"""
PAGES = [
    (1, NEWS, ["River crossing closed after flood", "The old bridge at Ferry Lane was closed on Tuesday evening after the river rose by almost two metres, the council said.",
               "Engineers will inspect the piers & the deck before it opens again; drivers should use the ring road.", "Bus line 4 ends at the market.", "Cyclists may use the weir.",
               "A spokesperson said that the work might take until Friday."]),
    (2, BLOG, ["How I repaired a radio", "It was silent when I got it, and the dial lamp was dead as well.", "First I replaced the two large capacitors, which had leaked over the years. Then I cleaned the switch.",
               "Never touch the chassis while it is plugged in.", "After an evening of work it plays again, if a little quietly."]),
    (3, BROKEN, ["Notes on bread", "The dough rests for a night in a cold room, covered with a damp cloth.", "In the morning it is shaped, rested again for an hour, and baked in a hot oven.", "Let it cool before you cut it, however hard that may be."]),
    (4, None, []), (5, "", []), (6, "<p>", []),
]


def test_pages_labelled_by_hand(spark, tmp_path):
    spark.createDataFrame([(i, f"u{i}", h) for i, h, _ in PAGES] * 2, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = rows(llm.QUERIES["op8_html_extraction"](spark, str(tmp_path)), "page_id", "url", "text", "n_chars")
    want = [(i, f"u{i}", "\n\n".join(b), len("\n\n".join(b))) for i, _, b in PAGES for _ in range(2)]
    assert got == sorted(want, key=repr)


def test_links_and_quotes():
    text = lambda page: html_tree.blocks(html_tree.parse(page)[0], lambda n: True)
    root, nodes = html_tree.parse("<a href=/foo/>link</a> rest")
    assert nodes[1].children == ["link"] and text('<p class="x>Hello world</p> more') == ["Hello world", "more"]
    assert text("<a title=it's>x</a>'s <b a='>'>y</b>") == ["x's y"] and text('<img alt="a > b">c<br/>d<span/>e') == ["c de"]

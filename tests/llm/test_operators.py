"""The ten operators on small tables: odd rows, and the contracts against brute force."""

import base64
import datetime
import random

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomlens.llm import bpe, decontaminate, html_extract, html_tree, line_dedup, minhash, pii, quality, substring_dedup, suffix_dedup, token_store
from loomlens.llm.common import connected_components, new_path

R = random.Random(5)
WORDS = ["the", "of", "Ünï", "and", "word,", "a", "x1", "zebra", "quick", "brown"]
LONG = " ".join(f"w{i}" for i in range(70))
#: (doc_id, text): nulls, nothing, blanks, a very long text, ties, repeats, near and exact copies.
ROWS = [
    (1, None), (2, ""), (3, "  \t\n"), (4, LONG), (5, LONG), (6, LONG.replace("w9 ", "v9 ")), (7, "One"), (8, "one"), (9, "one two"), (10, "word " * 4000),
    (11, "Ünï " + LONG + "\n" + "A shared line that is long enough to count here\n" * 2), (12, "\x0b" + LONG[: len(LONG) // 2]), (13, "x" * 3000), (14, "x" * 3000 + "y"),
    *[(20 + i, " ".join(R.choice(WORDS) for _ in range(R.randint(1, 120))) + f"\nA Shared Line that is long enough to count here\nend {i}") for i in range(12)],
    *[(40 + i, LONG + f" tail{i}") for i in range(4)],
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.withColumn("h", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("pos", F.lit("clash")).withColumn("component", F.lit(0))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def same(got, want):
    assert got == sorted(want, key=repr)


def sql(query, data=ROWS):
    import pyarrow as pa

    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([d for d, _ in data], pa.int64()), "text": pa.array([t for _, t in data], pa.string())}))
    cur = c.execute(query)
    return [d[0] for d in cur.description], cur.fetchall()


def test_quality_equals_sql(docs):
    names, want = sql(quality.OP4_SQL)
    got = quality.quality_rules(docs)
    same(rows(got, *names), want)
    assert not got.where("doc_id = 1").first()["kept"]


def test_quality_keeps_prose_and_drops_junk(spark):
    prose = "It was the best of the days and we went to the sea with all of our friends, for it is good. " * 3
    prose += " ".join(f"the {w} of my {w[::-1]} is" for w in "river mountain forest meadow harbour village market castle bridge garden".split())
    t = [(1, " ".join(dict.fromkeys(prose.split())) + " " + prose[:200] + " the sea of an old day is for the best."), (2, "WORD!! " * 80), (3, " ".join(f"w{i}$$$" for i in range(90)))]
    got = dict(rows(quality.quality_rules(spark.createDataFrame(t, "doc_id long, text string")), "doc_id", "kept"))
    assert not got[2] and not got[3]


def test_line_dedup_equals_sql(docs):
    names, want = sql(line_dedup.OP10_SQL)
    for heavy in (line_dedup.HEAVY, 1, 0):  # broadcast and joined keys
        got = line_dedup.line_dedup(docs, heavy=heavy).withColumn("kept_sha256", F.sha2("text", 256))
        same(rows(got, *names), want)
    assert sum(r[2] for r in rows(got, "doc_id", "n_lines", "n_dropped")) >= 11


def test_line_keys_ignore_the_case_of_ascii_alone(spark):
    """Equal hashes where translating A-Z gives equal keys, and nowhere else."""
    t = sorted({"".join(R.choice("aAkK\u212aéÉãÃßẞİiIıñÑΣσςß日\U0001f600\u00d7\u00f7\u00df\u00ff") for _ in range(R.randint(1, 3))) for _ in range(3000)})
    got = spark.createDataFrame([(x,) for x in t], "x string").select("x", line_dedup.key_hash(F.col("x")).alias("h")).collect()
    plain = {r["x"]: "".join(c.lower() if c.isascii() else c for c in r["x"]) for r in got}
    assert len({r["h"] for r in got}) == len(set(plain.values())) == len({(bytes(r["h"]), plain[r["x"]]) for r in got})


def test_texts_of_one_id_and_clashing_names(spark):
    line = "A line that is surely long enough to be counted as one"
    data = [(i, f"{line}\nown {i}") for i in range(6)] + [(None, line), (2, f"first\n{line.upper()}\nlast"), (2, f"{line}\nown 2"), (5, f"x\n{line}")]
    d = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS doc", "'k' AS lost", "2 AS row", "3 AS kept", "4 AS n", "5 AS pos", "6 AS `a.b`")
    got = line_dedup.line_dedup(d, keep=("doc", "lost", "row", "kept", "n", "a.b"))
    assert rows(got, "doc_id", "text", "doc", "a.b") == sorted([*[(i, f"own {i}", 1, 6) for i in range(5)], (5, f"{line}\nown 5", 1, 6), (None, "", 1, 6), (2, "first\nlast", 1, 6), (2, "own 2", 1, 6), (5, f"x\n{line}", 1, 6)], key=repr)
    q = quality.quality_rules(d, keep=("doc", "lost", "n", "a.b"))
    assert q.columns[:5] == ["doc_id", "doc", "lost", "n", "a.b"] and q.where("NOT kept").count() == len(data)


def test_bpe_trees_and_digests(docs):
    enc = bpe.load(bpe.default_path())
    for leaf in (7, 64, 1000):
        for t in [t or "" for _, t in ROWS] + ["a  b   c\n\n d", "x" * 99, " " * 50, "don't 'tis    a", "".join(R.choice(" \n\ta'sé1") for _ in range(300))]:
            assert bpe.encode(t, enc.encode_ordinary, leaf) == enc.encode_ordinary(t)
    leaf = bpe.leaf_encoder(enc)
    for t in (" " * 60_000, "a" + " " * 70_000 + "b  c", " \n" * 40_000 + "\n" * 60_000 + "x", "\u00a0" * 55_000 + " é"):
        assert leaf(t) == bpe.encode(t, leaf) == enc.encode_ordinary(t)
    got = bpe.bpe_round_trip(docs, leaf_chars=100)
    assert rows(got, "doc_id", "decoded") == sorted(((d, t or "") for d, t in ROWS), key=repr)
    d = bpe.map_tokens(docs, bpe.digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string").where("doc_id = 4").first()
    ids = enc.encode_ordinary(LONG)
    assert (d["n_tokens"], d["ids_sha256"], d["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(LONG))
    assert base64 and tiktoken


def test_suffix_dedup(docs):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for fan in (1024, 1):  # one hop, and two
        got = suffix_dedup.suffix_dedup(docs, fan=fan).select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, s) -> a + s[1] - s[0])").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
        same(rows(got, *cols), brute.suffix(ROWS))


def test_classes_of_windows_by_interval_expansion():
    """Contexts around equal grams: equal windows at the same distance from them, and no others, share a class."""
    for _ in range(40):
        grams = ["".join(R.choice("xy") for _ in range(4)) for _ in range(3)]
        text, anchor, low, high = "", [], [], []
        for _ in range(R.randint(1, 40)):
            left, right = ("".join(R.choice("ab\0") for _ in range(R.randint(0, 5))) for _ in range(2))
            if len(left) + len(right) >= 5:
                anchor.append(len(text) + len(left))
                low.append(len(text)), high.append(anchor[-1] - max(0, 5 - len(right)))
                text += left + R.choice(grams) + right
        if not anchor:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        grams = [text[i : i + 4] for i in anchor]
        context, start, kind = suffix_dedup.window_classes(raw, np.array([hash(g) & 0xFFFF for g in grams], np.uint64), *(np.array(x) for x in (anchor, low, high)), 9, 4)
        assert len(start) == sum(h - l + 1 for l, h in zip(low, high))
        seen = [(text[s : s + 9], anchor[c] - s) for c, s in zip(context, start)]
        assert all((kind[i] == kind[j]) == (seen[i] == seen[j]) for i in range(0, len(seen), 3) for j in range(len(seen)))


def test_substring_dedup(docs):
    for fan in (1024, 1):
        got = substring_dedup.substring_dedup(docs, fan=fan).withColumn("kept_sha256", F.sha2("text", 256))
        same(rows(got, "doc_id", "n_words", "n_removed", "kept_sha256"), brute.substring(ROWS))


def test_near_duplicates(docs):
    for size, leaders in ((minhash.BLOCK_BYTES, 4), (900, 4), (900, 0)):  # whole buckets; blocks of a few texts; without leaders
        got = minhash.near_duplicates(docs, width=2, block_bytes=size, leaders=leaders)
        same(rows(got, "doc_id", "n_shingles", "component_id", "kept"), brute.near(ROWS))
    assert {r[2] for r in rows(got, "doc_id", "n_shingles", "component_id") if r[0] in (4, 5, 6, 40)} == {4}


def test_blocks_of_buckets(spark):
    """Pairs of different labels of a bucket meet exactly once; a large label's own blocks do not."""
    rows_ = [(b, b % 3, 100 * b + i, label, 40) for b in range(4) for i, label in enumerate([1] * 9 + [2] * 7 + [3, 4, 5, 6][: b + 1])]
    for size in (100, 1000):
        got = minhash.blocks_of(spark.createDataFrame(rows_, "band long, no int, rep long, label long, bytes long"), size).collect()
        groups = {}
        for r in got:
            groups.setdefault((r["band"], r["low"], r["high"]), []).append(r)
        met = [tuple(sorted((x["rep"], y["rep"]))) for (_, low, high), g in groups.items() for i, x in enumerate(g) for y in g[i + 1 :] if low == high or x["block"] != y["block"]]
        want = {tuple(sorted((x[2], y[2]))) for x in rows_ for y in rows_ if x[0] == y[0] and x[3] != y[3]}
        assert len(met) == len(set(met)) and want <= set(met)
        if size == 100:
            assert max(len(g) for g in groups.values()) < 12 and not any({x["label"] for x in g} == {1} and lo != hi for (_, lo, hi), g in groups.items() if len({x["block"] for x in g}) > 1)


def test_hyper_registers():
    s = np.array([R.getrandbits(64) for _ in range(400)], np.uint64)
    a, b = minhash.registers(s[:300]), minhash.registers(s[50:])
    assert abs(minhash.estimate(a, b[None])[0] - 250 / 400) < 0.25 and (minhash.registers(s) == minhash.registers(s[::-1])).all()


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 60), (7, 7), (70, 70)], "a long, b long")
    assert rows(connected_components(e), "node", "component") == sorted([(i, 1) for i in range(1, 41)] + [(50, 50), (60, 50)], key=repr)
    assert connected_components(e.limit(0)).count() == 0


def test_decontamination(spark, docs):
    items = [(1, LONG), (2, "one two"), (3, None), (4, " "), (5, "the quick fox jumps over a lazy dog"), (6, "Ünï"), (7, "never seen words are here in this item today")]
    extra = [*ROWS, (90, "so THE quick, fox jumps over a lazy dog!"), (None, "the quick fox jumps over a lazy dog")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = docs.select("doc_id", "text").union(spark.createDataFrame(extra[len(ROWS) :], "doc_id long, text string"))
    want = brute.leaks(extra, items)
    assert {(90, 5), (None, 5), (9, 2)} <= want and 7 not in {i for _, i in want}
    for most in (200_000, 0):
        got = decontaminate.decontaminate(d, b, max_broadcast_rows=most)
        same(rows(got, "doc_id", "item_id"), want)
    assert decontaminate.decontaminate(d, b.limit(0)).count() == 0


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = new_path(spark, "store")
    token_store.write_store(docs, path)
    store = token_store.open_store(spark, path)
    same(rows(token_store.read_store(store), "key", "start", "n_tokens", "ids_crc32"), brute.store(ROWS, t))
    got = {r["key"]: r["ids"] for r in token_store.lookup(store, [4, 9, 777_777]).collect()}
    assert got == {4: [*t.encode(LONG).ids, 0], 9: [*t.encode("one two").ids, 0]}


def test_minimal_perfect_hash():
    h = token_store.key_hashes(list(range(5000)))
    seeds, slots = token_store.build_index(h)
    assert sorted(slots) == list(range(5000)) and len(seeds) == 1250


def encoded(e, texts):
    """ids of each text by the table of pieces"""
    import pyarrow as pa

    from loomlens.llm.hashing import buffers

    out = []
    for _, ids, sizes in e.encode(*buffers(pa.array(texts, pa.string()))):
        out += np.split(ids, np.cumsum(sizes)[:-1])
    return [x.tolist() for x in out]


def test_pieces_of_any_text():
    e = token_store.Encoder(token_store.default_path())
    assert e.direct
    texts = ["".join(R.choice(" \n\t\u00a0\u2003a'sBt.é×ß1_\x1c\0—…日(\"") for _ in range(R.randint(0, 20))) for _ in range(6000)]
    texts += ["", "<|endoftext|>", "a <|endoftext|> b", "don't  'tis", "x" * 5000, "\n\n\nA\n\n b \n", " ".join(f"w{i}é" for i in range(5000))]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(e, texts) == want and encoded(e, texts[::-1]) == want[::-1]


def test_a_full_pool_loses_nothing(monkeypatch):
    monkeypatch.setattr(token_store, "POOL", 600)
    e = token_store.Encoder(token_store.default_path())
    for k in range(30):
        texts = [" ".join(f"{'abcdefgh'[(i * k) % 8]}word {i} {k}" for i in range(40)), "the of and " * 20]
        assert encoded(e, texts) == [e.tokenizer.encode(t).ids for t in texts]


def test_pseudonyms(docs):
    key = b"k" * 32
    assert sorted(pii.permute(v, 10, 3, key) for v in range(1000)) == list(range(1000))
    assert all(pii.restore(pii.permute(v, r, n, key), r, n, key) == v for r, n in ((10, 1), (10, 7), (16, 4), (26, 5)) for v in range(0, r**n, max(1, r**n // 50)))
    text = "Mail a.b@mail5.example.com or +1 (663) 555-6869, card 4111 1111 1111 1111, 116.249.74.180, 2020-02-29, GB82 WEST 1234 5698 7654 32, 29/02/2020; version 1.2.3.400, 4111 1111 1111 1112."
    new, found = pii.pseudonymise(text, "k")
    assert [k for k, _, _ in found] == ["email", "phone", "card", "ip", "date", "iban", "date"]
    assert all(text[a:b] not in new for _, a, b in found) and new.endswith("version 1.2.3.400, 4111 1111 1111 1112.") and pii.pseudonymise(text, "k")[0] == new
    again = [k for k, _, _ in pii.pseudonymise(new, "k")[1]]
    assert again == [k for k, _, _ in found]  # formats and check digits hold
    days = [new[a : a + 10] for a in (new.index("-") - 4,)]
    assert days
    one, two = (pii.RULES["date"](x, key) for x in ("2020-02-29", "29/02/2020"))
    assert datetime.date.fromisoformat(one).strftime("%d/%m/%Y") == two
    assert [r[1] for r in rows(pii.pii(docs, "k"), "doc_id", "n_found")] == [0] * len(ROWS) and pii.pii(docs, "k").where("doc_id = 1").first()["text"] is None


def test_html(spark):
    trees = html_extract.model()
    r, right, total = random.Random(99), 0, 0
    for _ in range(60):
        nodes, y = html_extract.labelled(html_extract.sample_page(r))
        state = html_extract.decode(nodes, np.clip(trees.log_odds(html_extract.features(nodes)), -6, 6))
        for n, s in zip(nodes, state):  # what is below a cut or outside never contradicts its ancestor
            up = n.parent and state[nodes.index(n.parent)]
            assert n.parent is None or (s, up) not in ((html_extract.IN, html_extract.CUT), (html_extract.OUT, html_extract.IN), (html_extract.CUT, html_extract.OUT))
        right, total = right + ((state == html_extract.IN) == y).sum(), total + len(y)
    assert right / total > 0.985
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class=ad>Buy now</div><article><h1>A &amp; B</h1><p>First  text<br>goes\non, and on it goes for a while.<p><b>Second one, which is not closed.</article><div class='comments'><p>Nice post</p></div><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = dict(rows(html_extract.html_extract(df), "page_id", "text"))
    assert got == {1: "A & B\n\nFirst text goes on, and on it goes for a while.\n\nSecond one, which is not closed.", 2: "", 3: ""}
    root, _ = html_tree.parse("<p>a<div>b<ul><li>c<li>d</ul></p>e<table><tr><td>f<td>g<tr><td>h</table><script>x<b></script>i")
    assert html_tree.blocks(root, lambda n: True) == ["a", "b", "c", "d", "e", "f g", "h", "i"]


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op10"])
def test_empty_tables(spark, docs, name):
    empty = docs.limit(0)
    f = {
        "op2": bpe.bpe_round_trip, "op3": suffix_dedup.suffix_dedup, "op4": quality.quality_rules, "op5": minhash.near_duplicates, "op6": substring_dedup.substring_dedup,
        "op7": lambda d: pii.pii(d, "k"), "op10": line_dedup.line_dedup,
    }[name]
    assert f(empty).count() == 0

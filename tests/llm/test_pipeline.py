"""The pipeline against its stages in plain Python, and the registered queries."""

import random

import brute
import pytest
from test_operators import sql

import corpus_pipeline
from loomlens.llm import bpe, quality
from loomlens.llm import queries as llm

R = random.Random(11)
STOP = "the of and to a in is it that for".split()
ITEM = "a benchmark passage of thirteen words that should not be in the corpus"


def text(seed):
    r = random.Random(seed)
    return " ".join(r.choice(STOP) if i % 3 == 0 else "".join(r.choice("abcdefgh") for _ in range(6)) for i in range(120))


LINE = "\nThis very line is shared by many documents of the corpus"
DOCS = [
    *[(i, text(i) + LINE) for i in range(6)], (10, text(0) + " tail"), (11, text(1)), (12, text(30) + " " + ITEM + " " + text(31)), (13, "too short"), (14, None),
    (15, "SHOUT!! " * 90), (16, text(40)), (17, text(40).replace("the", "of", 1)),
]


def expected():
    names, rows = sql(quality.OP4_SQL, DOCS)
    good = {r[names.index("doc_id")] for r in rows if r[names.index("kept")]}
    docs = [(d, t) for d, t in DOCS if d in good]
    holders = [d for d, t in docs if LINE.strip() in t.split("\n")]
    assert len(holders) >= 5
    docs = [(d, t if d not in holders or d == max(holders) else t.replace(LINE, "")) for d, t in docs]
    kept = {r[0] for r in brute.near(docs, 5) if r[3]}
    docs = [(d, t) for d, t in docs if d in kept]
    leaky = {d for d, _ in brute.leaks(docs, [(1, ITEM)])}
    enc = bpe.load(bpe.default_path())
    return sorted((d, *bpe.digests(enc.encode_ordinary(t), t.encode())) for d, t in docs if d not in leaky)


def test_pipeline(spark, tmp_path):
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = expected()
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    assert {10, 11, 12, 13, 14, 15, 17}.isdisjoint({r[0] for r in got}) and {0, 1, 16} <= {r[0] for r in got}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)


def test_one_query_for_each_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(llm.ORACLE_SQL) <= set(llm.QUERIES)


@pytest.mark.parametrize("name, brute_force, columns", [
    ("op3_suffix_array_dedup", brute.suffix, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")),
    ("op5_minhash_near_dedup", brute.near, ("doc_id", "n_shingles", "component_id", "kept")),
    ("op6_substring_dedup", brute.substring, ("doc_id", "n_words", "n_removed", "kept_sha256")),
])
def test_queries_on_the_smallest_tables(spark, name, brute_force, columns):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r[c] for c in columns) for r in llm.QUERIES[name](spark, d).collect()) == sorted(brute_force(docs))

"""Cases that the operators once left out."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlens.llm import decontaminate, pii, token_store
from loomlens.llm.common import new_path


def found(text):
    new, spans = pii.pseudonymise(text, "k")
    assert all(text[a:b] not in new for _, a, b in spans)
    return [(k, text[a:b]) for k, a, b in spans]


def test_valid_values_before_further_groups():
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    for tail in (" 12/27", " 12", " 1234 12", "", ", 12"):
        assert found(f"pay {card}{tail}.")[0] == ("card", card)
    assert found("4111111111111111 12/27") == [("card", "4111111111111111")]
    for tail in (" BIC", " BIC KREDBEBB", " AB", ""):
        assert found(f"{iban}{tail}") == [("iban", iban)]
    assert found("+44 20 7946 0958 2024 1234") == [("phone", "+44 20 7946 0958")]
    assert found("4111 1111 1111 1112 12/27") == []
    # 18 4111 1111 1111 passes Luhn as well, but a whole card begins inside.
    heads = [h for h in range(10, 100) if pii.luhn_digit(f"{h}41111111111") == "1"]
    assert heads and all(found(f"{h} {card}") == [("card", card)] for h in heads if pii.luhn_digit(f"{h}411111111111111") != "1")


def test_date_before_a_time():
    assert found("at 2024-01-05T10:00:00Z, 2024-01-05t1000 and 2024-01-05") == [("date", "2024-01-05")] * 3
    assert found("2024-13-05T10:00:00Z 2024-01-05Tx 2024-01-05-10:00") == []


def leaks(docs, items, percent=80, k=5):
    """{(doc_id, item_id)}: windows as long as the item, or the whole of a shorter text."""
    out = set()
    for d, t in docs:
        for i, v in items:
            w, v = t.lower().split(), v.lower().split()
            n, size = min(k, len(v)), min(len(v), len(w))
            bag = lambda words: Counter(tuple(words[j : j + n]) for j in range(len(words) - n + 1))  # noqa: E731,B023
            want = bag(v)
            for s in range(len(w) - size + 1):
                own = bag(w[s : s + size])
                if own and 100 * sum((own & want).values()) >= percent * sum((own | want).values()):
                    out.add((d, i))
    return out


def leaked(spark, docs, items):
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]) for r in got}, got


def test_documents_shorter_than_the_item(spark):
    words = [f"w{i}" for i in range(50)]
    items = [(1, " ".join(words)), (2, "a b c d e f"), (3, "one two three")]
    cut = lambda n: " ".join(words[:n])
    docs = [(n, cut(n)) for n in (1, 4, 30, 40, 41, 42, 49, 50)] + [(100, " ".join(words[5:])), (101, cut(20) + " x " + cut(50)[len(cut(20)) + 1 : -4]), (102, "a b c d e"), (103, "one two"), (None, cut(49)), (None, cut(80) + " y z q")]
    got, rows = leaked(spark, docs, items)
    assert got == leaks(docs, items) and {(41, 1), (49, 1), (100, 1), (None, 1)} <= got and (40, 1) not in got
    assert {(r["start"], r["n_windows"], r["similarity"]) for r in rows if r["doc_id"] == 49} == {(0, 1, 0.978260)}


def test_differences_of_one_repeated_shingle(spark):
    """Similarity 0.8 exactly, and the difference is a run of one word: 16 copies of a shingle for 16 of another."""
    body = lambda i: " ".join(f"i{i}w{j}" for j in range(164))
    items = [(i, f"{body(i)}{f' z{i}' * 20}") for i in range(8)]
    docs = [(i, f"{body(i)}{f' y{i}' * 20}") for i in range(8)] + [(9, " ".join(["z0"] * 184)), (10, body(1))]
    got, _ = leaked(spark, docs, items)
    assert got == leaks(docs, items) == {(i, i) for i in range(8)} | {(10, 1)}


def store_of(spark, docs, kind):
    path = new_path(spark, "store")
    token_store.write_store(spark.createDataFrame(docs, f"doc_id {kind}, text string"), path)
    return token_store.open_store(spark, path)


def test_lookup_reads_the_parts_of_the_key_alone(spark):
    enc = token_store.encoder(token_store.default_path()).tokenizer
    for kind, keys in (("long", [-5, 0, *range(2, 60), 101]), ("string", ["", "10", "9", "b", "\u00e9", "a\nb", *map(str, range(20, 60))])):
        store = store_of(spark, [(k, f"text of {k}") for k in keys] + [(None, "none")], kind)
        assert store.select("shard").distinct().count() > 1
        want = {k: [*enc.encode(f"text of {k}").ids, 0] for k in keys}
        absent = [777, -777] if kind == "long" else ["x", "\uffff"]
        got = {r["key"]: r["ids"] for r in token_store.lookup(store, [*keys, None, *absent]).collect()}
        assert got.pop(None) == [*enc.encode("none").ids, 0] and got == want
        assert token_store.lookup(store, []).count() == token_store.lookup(store, absent).count() == 0
        assert {r["key"] for r in token_store.read_store(store).collect()} == {*keys, None}
        one = keys[-1]
        assert token_store.parts_of(store, [one]).count() == 1
        plan = token_store.parts_of(store, [one])._jdf.queryExecution().toString()
        assert "PushedFilters: [IsNotNull(first_key), IsNotNull(last_key), LessThanOrEqual(first_key," in plan


def test_rows_of_one_key_spread_over_parts(spark):
    docs = [(7, f"text number {i} of one key") for i in range(60)] + [(1, "a"), (9, "b"), (7, "text number 3 of one key"), (7, None)]
    path = new_path(spark, "store")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    token_store.write_store(d.repartition(40), path, part_ids=20)
    store = token_store.open_store(spark, path)
    rows = token_store.read_store(store).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["key"] for r in rows] == [1, *[7] * 62, 9] and [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    found = token_store.lookup(store, [7]).collect()
    assert len(found) > 1
    assert sum(len(r["ids"]) for r in found) == sum(r["n_tokens"] for r in rows if r["key"] == 7)


def test_store_of_nothing_and_of_other_keys(spark):
    assert token_store.read_store(store_of(spark, [], "long")).count() == 0
    with pytest.raises(TypeError):
        store_of(spark, [(1.5, "a")], "double")

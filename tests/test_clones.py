"""Repeated windows by runs of equal picks, against counting every window."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlens.operators import clones


def counted(texts, m):
    """(md5, n) of windows that occur more than once."""
    seen = Counter(" ".join(w[i : i + m]) for w in texts for i in range(len(w) - m + 1))
    return sorted((hashlib.md5(x.encode()).hexdigest(), n) for x, n in seen.items() if n > 1)


def shuffled(spark):
    """Rows that all stages have shuffled so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("m", [1, 2, 3, 5, 8, 30])
def test_repeated_windows_of_odd_texts(spark, m):
    """Periods of all lengths, copies with edits, few different words, a passage in every text, texts as short as a window and shorter."""
    r = random.Random(m)
    words = lambda n, of: [f"w{r.randrange(of)}" for _ in range(n)]
    passage = words(m + 9, 10**6)
    texts = [words(p, 10**6) * (3 * m // p + 3) for p in (1, 2, 3, 7, 15, 16, 17, 31)] + [words(70, 2), words(70, 3), words(m, 9), words(m - 1, 9), []]
    texts += [words(k, 10**6) + passage + words(k, 10**6) for k in range(9)] + [passage[:m], passage[:m]]
    copy = words(120, 10**6)
    texts += [copy, copy, copy[:60] + ["x"] + copy[60:], copy[45:]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "k long, tokens array<string>")
    assert sorted(tuple(x) for x in clones.repeated_windows(df, "k", "tokens", m).collect()) == counted(texts, m)


def test_windows_that_are_not_repeated_stay_in_their_file(spark):
    r = random.Random(5)
    texts = [[f"w{r.randrange(10**9)}" for _ in range(300)] for _ in range(60)]
    texts[7][40:90] = texts[31][200:250]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "k long, text string")
    before = shuffled(spark)
    got = sorted(tuple(x) for x in clones.repeated_windows(df, "k", F.split("text", " "), 30).collect())
    assert got == counted(texts, 30) and len(got) == 21
    assert shuffled(spark) - before < 60 * 271 / 4


def test_clone_groups_count_no_window_that_cannot_repeat(spark):
    """All 16,260 windows would be shuffled if all were counted."""
    r = random.Random(6)
    texts = [[f"w{r.randrange(10**9)}" for _ in range(300)] for _ in range(60)]
    texts[7][40:90] = texts[31][200:250]
    rows = [(f"f{i}", [(x, k, k) for k, x in enumerate(w, 1)]) for i, w in enumerate(texts)]
    files, before = spark.createDataFrame(rows, "path string, tokens array<struct<text:string,line:int,end_line:int>>"), shuffled(spark)
    got = clones.clone_groups(files).collect()
    whole = [tuple(i) for g in got if g["token_count"] == 50 for i in g["instances"]]
    assert len(got) == 21 and sorted(whole) == [("f31", 201, 250), ("f7", 41, 90)]
    assert shuffled(spark) - before < 60 * 271 / 2

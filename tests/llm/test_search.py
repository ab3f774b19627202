"""Ranked search against brute force, with windows and slices of any size."""

import collections
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ITEMS = [(1, "ab cd ab ef zz"), (2, "Ünter a1-b2"), (3, None), (4, "!?"), (None, "cd cd"), (1, "nowhere"), (5, "ef " * 40), (6, "ÜNTER")]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    held = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            if n:
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
                if score > 0:
                    scored.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["ab", "cd", "ef", "Gh", "x1", "ünter", "Ünter", "zz--", "a1", "b2;", "\x7fq"]) for _ in range(r.randint(0, 30)))) for i in range(150)]
    rows += [(500 + i, "cd ef cd") for i in range(40)]  # ties
    rows += [(900, None), (901, ""), (902, " .,"), (None, "ab cd"), (3, "ab ab"), (903, "ef" * 50000), (904, "ab " * 30000), (905, "é中\U0001f600"), rows[7]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "rank", "item_id", "k", "n")}).repartition(3)


@pytest.mark.parametrize(("window", "slice_bytes"), [(4096, 1 << 20), (8, 1 << 20), (64, 30)])
def test_search_brute_force(spark, docs, window, slice_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit(1))
    got = search.search(frame(spark, docs), items, window=window, slice_bytes=slice_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, ITEMS)


def test_search_of_nothing(spark, docs):
    empty, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(empty, items).count() == 0
    assert search.search(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert search.search(frame(spark, [(1, None), (2, "  ")]), items).count() == 0


def test_terms_are_the_runs_of_the_pattern():
    r = random.Random(4)
    alphabet = "aZ09_-/:@[`{~\x00\x7f\x80ÿ中\U0001f600 \n"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, ""]
    found, n = search.terms(pa.array(texts, pa.string()))
    assert [t.decode() for t in found.to_pylist()] == [t for x in texts for t in terms(x)]
    assert n.tolist() == [len(terms(x)) for x in texts]
    found, n = search.terms(pa.array(texts, pa.string()).slice(7, 20))
    assert [t.decode() for t in found.to_pylist()] == [t for x in texts[7:27] for t in terms(x)]

"""The manifest against trees built in one place, its proofs folded again by hand."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def code(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        first = i // 8 * 8
        run = level[first : first + 8]
        out.append((i - first, run[: i - first] + run[i - first + 1 :]))
        i //= 8
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(map(code, r)), r))
    groups = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in groups}
    top = levels([trees[k][-1][0] for k in groups])
    out = []
    for at, k in enumerate(groups):
        above = siblings(top, at)
        for i, (_, _, leaf, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            steps = siblings(trees[k], i) + above
            folded = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                folded = h(map(code, (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))))
            for place, others in steps:
                folded = h([*others[:place], folded, *others[place:]])
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], h(x for _, o in steps for x in o), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = [(i, f"s{i % 3}", r.choice(["en", "en", "en", "de", "é"]), i, r.choice(["Abc", "abc", "É x"]) + str(i)) for i in range(700)]
    out += [(1000 + i, None, f"l{i:02}", None, "T") for i in range(12)]  # groups of one row, and more groups than a parent holds
    out += [(2000, "s", None, 1, None), (2001, "s", None, 1, ""), (None, None, None, None, None), (None, "s", "en", 1, "No id"), (2002, "s", "", 5, "x" * 200000), out[5], (5, "other", "en", 5, "Same id")]
    return out


def got(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=repr)


@pytest.mark.parametrize(("climb", "descent"), [(6, 3), (1, 1), (2, 3)])
def test_manifest_brute_force(spark, rows, climb, descent, monkeypatch):
    monkeypatch.setattr(M, "CLIMB", climb)
    monkeypatch.setattr(M, "DESCENT", descent)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("tree", "level", "index", "digest", "under", "n")}).repartition(5)
    assert got(M.manifest(docs, M.lowered_thirds())) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    assert got(M.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), M.lowered_thirds())) == brute(rows)


def test_proofs_hold_and_tell_changes(spark, rows):
    out = M.manifest(spark.createDataFrame(rows[:100], SCHEMA)).collect()
    assert all(r.verified and M.fold(bytes.fromhex(r.leaf), r.proof).hex() == r.root == r.folded_root for r in out)
    assert all(M.fold(bytes(32), r.proof).hex() != r.root for r in out)

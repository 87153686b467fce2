"""Operators over vectors and repeated passages, against plain versions."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from helpers import LONG, odd
from pyspark.sql import functions as F

from tideline.llm import hard_negatives, queries, substring_dedup, whitening

SF = "/root/testdata/sf0.001"


# whitening


@pytest.mark.parametrize("low, high, rows", [(-150, 150, 300), (-3, 4, 64), (7, 8, 5), (-(2**40), 2**40, 70), (-(2**63), 2**63 - 1, 40)])
def test_scatter_is_exact(low, high, rows):
    rng = np.random.default_rng(rows)
    x = rng.integers(low, high, (rows, 5), "i8", endpoint=high == 2**63 - 1)
    x[:, 2] = x[0, 2]
    sums, cross = whitening.scatter(x)
    plain = [[int(v) for v in row] for row in x]
    assert list(sums) == [sum(r[d] for r in plain) for d in range(5)]
    for i in range(5):
        for j in range(i, 5):
            assert cross[i, j] == sum(r[i] * r[j] for r in plain)


def _fit_list(vectors):
    def whole(c):
        return min(max(int(np.floor(np.float64(c) * 256)), -(2**63)), 2**63 - 1)

    usable = [v for v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    return [tuple(map(whole, v)) for v in usable]


def _check_whitened(rows, vectors):
    """rows: of op13_whitening; vectors: id to vector."""
    levels = {i: x for i, v in vectors.items() for x in _fit_list([v])}
    fit = sorted(set(levels.values()))
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    exact = [[Fraction(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j], n * n) for j in range(dims)] for i in range(dims)]
    values, axes = np.linalg.eigh(np.array(exact, dtype=float))
    values, axes = values[::-1], axes[:, ::-1]
    assert {(r["vec_id"], r["component"]) for r in rows} == {(i, k + 1) for i in levels for k in range(min(4, dims))}
    signs = {}
    for r in rows:
        x, k = levels[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        white = float(np.array([float(a - Fraction(s, n)) for a, s in zip(x, sums)]) @ axes[:, k] / np.sqrt(values[k]))
        signs.setdefault(k, np.sign(white) * np.sign(r["whitened"]) if abs(white) > 0.01 else None)
        assert r["whitened"] == pytest.approx((signs[k] or 1) * white, abs=1e-8) or signs[k] is None
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    rows = queries.op13_whitening(spark, SF).collect()
    _check_whitened(rows, {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()})


def _embeddings(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_whitening_of_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    good = {i: [float(np.float32(rng.gauss(0, 1 + d))) for d in range(3)] for i in range(40)}
    good |= {100 + i: good[i % 3] for i in range(30)}  # copies count once
    bad = {200: None, 201: [1.0, None, 2.0], 202: [1.0, float("nan"), 2.0], 203: [float("inf"), 0.0, 0.0], 204: [1.0, 2.0], 205: []}
    rows = [(i, v, 0) for i, v in (good | bad).items()] + [(7, good[7], 1)]
    found = queries.op13_whitening(spark, _embeddings(spark, tmp_path, rows)).collect()
    assert sum(r["vec_id"] == 7 for r in found) == 6
    _check_whitened(found, good)


def test_whitening_without_spread(spark, tmp_path):
    rows = queries.op13_whitening(spark, _embeddings(spark, tmp_path / "a", [(i, [1.5, -2.0], 0) for i in range(3)])).collect()
    assert len(rows) == 6 and all((r["n"], r["deviation"], r["whitened"], r["explained"]) == (1, 0, None, None) for r in rows)
    line = queries.op13_whitening(spark, _embeddings(spark, tmp_path / "b", [(i, [float(i), float(-i)], 0) for i in range(5)])).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}
    assert queries.op13_whitening(spark, _embeddings(spark, tmp_path / "c", [])).count() == 0


# hard negatives


def _mined(rows, positives=5, negatives=10):
    kept = [(i, (la + 1) % 10 if i % 7 == 0 else la, [int(np.floor(np.float64(c) * 256)) for c in v]) for i, v, la in rows]
    out = set()
    for a, la, x in kept:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, lb) for i, lb, y in kept if i != a)
        for minus, p, _ in [s for s in scored if s[2] == la][:positives]:
            inside = [s for s in scored if s[2] != la and 30 * -minus <= -100 * s[0] <= 90 * -minus]
            out |= {(a, p, k + 1, i, -minus, -m) for k, (m, i, _) in enumerate(inside[:negatives])}
    return out


def _as_set(df):
    rows = df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_negatives_over_many_blocks(spark):
    rng = random.Random(8)
    common = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, common if i % 3 == 0 else [rng.gauss(0.5, 1) for _ in range(6)], rng.choice([0, 0, 0, 1, 2, 5])) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(hard_negatives.prepared(df, label=label), F.col("vec_id") % 100 == 0, block=100, part=3, leaf=8)
    assert _as_set(found) == _mined(rows)


def test_search_prunes_and_finds_the_best():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (2000, 3))
    a = rng.integers(-50, 50, (1, 3))
    tree, scored = hard_negatives.Tree(x, 16), []
    lower, upper = tree.bounds(a)
    exact = x @ a[0]
    for node, rows in enumerate(tree.leaves):
        assert lower[0, tree.inner + node] <= exact[rows].min() and exact[rows].max() <= upper[0, tree.inner + node]

    def score(rows):
        scored.append(len(rows))
        return exact[rows]

    ids = np.arange(len(x))[::-1].copy()
    windows = [(-(2**60), 2**60), (100, 500)]
    found = hard_negatives.search(tree, score, ids, lower[0], upper[0], windows, 10, np.ones(len(x), bool))
    for (least, most), (s, i) in zip(windows, found):
        want = sorted((-v, n) for v, n in zip(exact.tolist(), ids.tolist()) if least <= v <= most)[:10]
        assert [(-v, n) for v, n in zip(s.tolist(), i.tolist())] == want
    assert sum(scored) < len(x) / 2


def test_negatives_of_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    good = [(i, [float(np.float32(rng.gauss(1, 1))) for _ in range(4)], i % 4) for i in range(0, 450, 5)]
    bad = [(1000, None, 1), (1100, [1.0, None, 1.0, 1.0], 1), (1200, [float("nan")] * 4, 1), (1300, [1.0] * 4, None), (None, [1.0] * 4, 1), (1400, [1.0] * 3, 1)]
    found = queries.op11_hard_negatives(spark, _embeddings(spark, tmp_path / "a", good + bad + good[:3]))
    assert _as_set(found) == _mined(good)
    assert queries.op11_hard_negatives(spark, _embeddings(spark, tmp_path / "b", [])).count() == 0
    huge = [(100 * i, [3e37 * (-1) ** i] * 4, i % 2) for i in range(6)]
    assert queries.op11_hard_negatives(spark, _embeddings(spark, tmp_path / "c", huge)).count() >= 0


# repeated passages


def _plain(rows):
    """Windows by smallest id, all in one dictionary."""
    def words(t):
        return (t or "").encode().split()

    least = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for s in range(len(w) - 49):
                k = tuple(w[s : s + 50])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        if i is not None:
            for s in range(len(w) - 49):
                if least[tuple(w[s : s + 50])] < i:
                    gone |= set(range(s, s + 50))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def _deduped(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op12_substring_dedup(spark, str(tmp_path)).collect()), key=repr)


def test_passages_of_all_sorts(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["ñ", "漢字", "a\x1cb", "c\xa0d", "e f"]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [prose(n) for n in (50, 51, 49, 60, 90, 120, 400)]
    rows = []
    for i in range(160):
        parts = prose(rng.choice([0, 3, 30, 70]))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:  # a changed word; neighbours of the passage that some share and some don't
                p[rng.randrange(len(p))] = "changed" + rng.choice("ab")
            at = rng.choice([0, 0, 10])
            parts += p[at:] + rng.choice([["end", "of", "it"], prose(5), passages[4][:30]])
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [(500 + i, rows[7][1] + " same tail for all of the group") for i in range(40)] + [(600 + i, rows[9][1]) for i in range(30)]
    rows += [(5, " ".join(passages[6])), (5, " ".join(passages[6][:60] + ["other"])), (5, rows[5][1]), (None, " ".join(passages[6])), (-3, " ".join(prose(80)))]
    rng.shuffle(rows)
    assert _deduped(spark, tmp_path, rows) == _plain(rows)


def test_a_word_repeated_and_cycles(spark, tmp_path):
    rows = [(3, "a " * 300), (2, "a " * 70), (9, "a " * 49), (4, "a b " * 100), (8, "b a " * 40 + "x"), (7, "x y z " * 60), (11, "y z x " * 30 + "a " * 60), (12, "z " * 51)]
    assert _deduped(spark, tmp_path, rows) == _plain(rows)


def test_anchor_is_the_leftmost_least():
    rng = random.Random(4)
    hashes = substring_dedup.Hashes()
    for n, kinds in ((50, 3), (140, 2), (300, 1), (400, 30)):
        found = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        grams = defaultdict(list)
        segments = substring_dedup.anchors(found, hashes)
        of = {s: (at, g) for g, at, first, end in segments for s in range(first, end)}
        assert sorted(of) == list(range(n - 49))
        for s, (at, g) in of.items():
            assert s <= at <= s + 50 - substring_dedup.GRAM
            grams[tuple(found[s : s + 50])].append((at - s, g))
        assert all(len(set(v)) == 1 for v in grams.values())


def test_passages_of_odd_rows(spark, tmp_path):
    docs = odd(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in queries.op12_substring_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert found == _plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    longer = docs.where("doc_id = 4").withColumn("doc_id", F.lit(40).cast("long")).withColumn("text", F.concat(F.lit("new start "), F.lit(LONG))).unionByName(docs)
    out = substring_dedup.deduplicated(longer)
    assert out.columns == docs.columns and out.count() == longer.count()
    assert {r["text"] for r in out.where("doc_id = 40").collect()} == {"new start"}
    assert {r["text"] for r in out.where("doc_id = 5").collect()} == {r["text"] for r in docs.where("doc_id = 5").collect()}
    assert substring_dedup.spans(docs.where("false")).count() == 0

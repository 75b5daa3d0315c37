"""Whitening, vector codes and mixing, against plain computations and on odd tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmark.llm import codes, common, mixing, whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [(9001, None, 1), (9002, [None, 1.0], 1), (9003, [NAN] * 16, None), (9004, [INF] * 16, 2), (9005, [1.0] * 3, 2), (9006, [], 2)]


def _vectors(n=300, d=16, seed=0):
    """With repeated rows, a frequent vector, null labels and ids, and directions of very different spread."""
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * np.logspace(0, -1.2, d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    x[: n // 3] = x[0]
    rows = [(int(k), [float(np.float32(v)) for v in row], [None, 1, 2, 7][k % 4]) for k, row in enumerate(x)]
    return [*rows, rows[5], (None, rows[7][1], 3)]


def test_jacobi():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 8, 17):
        a = rng.normal(size=(d, d)) * np.logspace(0, -9, d)
        values, v = whitening.jacobi(a)
        assert np.allclose(values / np.linalg.svd(a)[1], 1, rtol=1e-9) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
        left = a @ v
        assert np.allclose(left.T @ left, np.diag(values**2), atol=1e-13 * values[0] ** 2)
    # columns of very different lengths keep their own accuracy
    a = np.linalg.qr(rng.normal(size=(6, 6)))[0] * np.logspace(0, -14, 6)
    assert np.allclose(whitening.jacobi(a)[0] / np.logspace(0, -14, 6), 1, rtol=1e-12)
    assert whitening.jacobi(np.zeros((4, 4)))[0].tolist() == [0.0] * 4


@pytest.mark.parametrize("k", [16, 3])
def test_whitening(spark, k):
    rows = _vectors()
    df = spark.createDataFrame([*rows, *ODD], EMBEDDINGS).withColumn("x", F.lit(1)).withColumn("component", F.lit("c")).repartition(5)
    got = {}
    out = whitening.whiten(df, components=k).collect()
    for r in out:
        got.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in e] for _, e, _ in rows])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    away = (n * fit - total) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(out) == len(rows) * k
    for vec_id, e, _ in rows:
        mine = n * np.array([math.floor(64 * v) + 1_000_000 for v in e]) - total
        for c in range(1, k + 1):
            for r in got[vec_id][c]:
                want = (mine / n) @ vectors[:, c - 1] / values[c - 1] ** 0.5
                assert r["n"] == n and r["deviation"] == sum(int(v) ** 2 for v in mine) and r["identity_error"] < 1e-10
                assert abs(abs(r["whitened"]) - abs(want)) < 1e-9 and abs(r["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9
    assert len(got[5][1]) == 2 and len(got[None][1]) == 1


def test_whitening_of_flat_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, EMBEDDINGS)
    assert whitening.whiten(frame([])).count() == whitening.whiten(frame(ODD[:1])).count() == whitening.whiten(frame([(6, [], 0)])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0], 0)] * 3)).count() == 0
    line = whitening.whiten(frame([(k, [k / 64, -k / 64, 0.5], 0) for k in range(10)])).collect()
    assert len(line) == 10 and all(abs(r["explained"] - 1) < 1e-12 for r in line) and abs(sum(r["whitened"] ** 2 for r in line) / 10 - 1) < 1e-12
    wide = spark.createDataFrame([(k, [1e30 * (-1) ** k, 3e38]) for k in range(4)], "vec_id long, embedding array<float>")
    assert [r["deviation"] for r in whitening.whiten(wide).collect()] == [None] * 4


def test_merged_in_a_tree(spark):
    parts = spark.range(0, 1500, numPartitions=7).select(F.col("id").cast("string").cast("binary").alias("part"))
    assert common.merged(parts, lambda a, b: str(int(a) + int(b)).encode()) == str(1499 * 750).encode()
    assert common.merged(parts.limit(0), lambda a, b: a) is None


def plain_codes(rows, parts, entries, rounds, scale=256):
    """vec_id -> code, error; and the codebooks."""
    x = [(k, [math.floor(scale * v) for v in e], label) for k, e, label in rows]
    width = -(-len(x[0][1]) // parts)
    x = [(k, v + [0] * (width * parts - len(v)), label) for k, v, label in x]
    first = sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in first] for p in range(parts)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(entry, part, strict=True)), k) for k, entry in enumerate(book))

    cut = [[v[p * width : (p + 1) * width] for _, v, _ in x] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            mine = [nearest(books[p], part)[1] for part in cut[p]]
            for k in range(len(books[p])):
                if n := mine.count(k):
                    books[p][k] = [sum(c) // n for c in zip(*(part for part, m in zip(cut[p], mine, strict=True) if m == k), strict=True)]
    found = [[nearest(books[p], part) for p, part in enumerate(whole)] for whole in zip(*cut, strict=True)]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], books


@pytest.mark.parametrize(("parts", "entries", "scale"), [(16, 64, 256), (4, 40, 8), (5, 256, 256), (4, 30, 2.0**40)])
def test_codes(spark, parts, entries, scale):
    rows = _vectors(200)
    df = spark.createDataFrame([*rows, *ODD], EMBEDDINGS).withColumns({"x": F.lit(1), "code": F.lit("c"), "of": F.lit(0)}).repartition(5)
    out = codes.compress(df, parts, entries, scale=scale).collect()
    want, books = plain_codes(rows, parts, entries, 2, scale)
    errors = {}
    for (_, _, label), (_, error) in zip(rows, want, strict=True):
        errors[label] = errors.get(label, 0) + error
    long = lambda v: v if v < 2**63 else None
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = sorted(((k, code, long(error), long(errors[label])) for (k, _, label), (code, error) in zip(rows, want, strict=True)), key=key)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out), key=key) == expected
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in out} == {digest}


def test_tree_leaves_out_and_keeps_ties():
    rng = np.random.default_rng(2)
    for spread in (2, 5, 300):
        entries, points = rng.integers(-spread, spread, (64, 4)), rng.integers(-spread, spread, (3000, 4))
        tree = codes.Tree(entries)
        at, best = tree.nearest(points)
        all_ = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (at == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all()
        assert tree.compared < 0.75 * all_.size


def test_codes_of_small_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, EMBEDDINGS)
    assert codes.compress(frame([])).count() == codes.compress(frame([ODD[0], ODD[5]])).count() == 0
    one = codes.compress(frame([(3, [1.0] * 16, None), *ODD])).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in one] == [(3, "00" * 16, 0, 0)]
    assert codes.compress(frame([(3, [1.0] * 16, None)]).drop("label")).first()["label_error"] == 0
    with pytest.raises(ValueError):
        codes.compress(frame([]), entries=257)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _mixed(docs, **more):
    rows = [tuple(r) for r in mixing.mix(docs, **more).collect()]
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, of = total - sum(fixed.values()), sum(w for s, w in weight.items() if s not in fixed)
        share = {s: left * w / of for s, w in weight.items() if s not in fixed} if of else {}
        over = {s: most * sizes[s] for s, v in share.items() if v > most * sizes[s]}
        if not over:
            return share | fixed
        fixed |= over


@pytest.mark.parametrize("block", [1024, 4])
def test_mix(spark, block):
    rng = random.Random(block)
    sources = ["b", "a", "é", "Z", "tiny", None, "c"]
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 2, 3, 10, 100, rng.randint(1, 400)])), "en", s if (s := rng.choice(sources)) != "tiny" else "b", 0) for k in range(1500)]
    rows += [(5000, "one  two\tthree\n", "en", "tiny", 0), (None, "x y", "en", "c", 0), (5001, None, None, None, None), (5002, "", "en", "empty", 0)]
    rows += [(7, "same same same", "en", "c", 0)] * 300 + [(None, "no id here", "en", "a", 0)] * 50
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumns({"nth": F.lit(1), "size": F.lit("s"), "p": F.lit(2), "n": F.lit(0)})
    out = _mixed(docs.repartition(3), block=block)
    assert out == _mixed(docs.repartition(7).orderBy("n_chars"), block=block)
    count = lambda t: len((t or "").split())
    sizes, taken, copies = {}, {}, {}
    by = {}
    for d, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets(sizes)
    assert sorted((d is None, d or 0, count(t)) for d, t, *_ in rows) == sorted((r[0] is None, r[0] or 0, r[1]) for r in out)
    of = {v: k for k, v in want.items()}
    for doc_id, size, source_size, target, words in out:
        s = min(want, key=lambda k: (abs(want[k] - target), sizes[k] != source_size))
        assert sizes[s] == source_size and abs(target - want[s]) < 1e-6 * max(1, target) and 0 <= words <= 3 * size
        taken[s] = taken.get(s, 0) + words
        by.setdefault(s, []).append((size, words))
        copies[s] = copies.get(s, 0) + (words / size if size else target / source_size if source_size else 0)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6, s
        if sizes[s]:
            times = want[s] / sizes[s]
            assert abs(copies[s] - times * len(by[s])) < 3, s
            odd = [1 for size, words in by[s] if size and words % size]
            assert len(odd) <= 2 and all(math.floor(times) * size <= w <= math.ceil(times) * size for size, w in by[s])
    assert len(of) > 4


def test_mix_of_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, DOCUMENTS)
    assert mixing.mix(frame([])).count() == 0
    assert _mixed(frame([(1, None, None, None, None), (2, "", "en", "a", 0)])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    # one source takes itself once; a source of a few words is taken three times, what is over goes to the other
    assert _mixed(frame([(k, "a b c", "en", "s", 0) for k in range(5)])) == [(k, 3, 15, 15.0, 3) for k in range(5)]
    out = _mixed(frame([(1, "a b", "en", "b", 0), (2, " ".join("c" * 100), "en", "a", 0)]))
    assert out == [(1, 2, 2, 6.0, 6), (2, 100, 100, 96.0, 96)]


def test_flight_keeps_both_sums():
    rng = random.Random(4)
    units = [(rng.choice([1, 5, 5, 300, rng.randint(1, 20_000)]), rng.random()) for _ in range(2000)]
    flight = mixing.Flight()
    for row, (size, p) in enumerate(units):
        flight.add(row, size, p, rng.random())
    after = dict(flight.settled) | {r: p for r, _, p in flight.open}
    assert len(after) == 2000 and len(flight.open) <= 2 and set(dict(flight.settled).values()) == {0.0, 1.0}
    assert abs(sum(after.values()) - sum(p for _, p in units)) < 1e-6
    assert abs(sum(units[r][0] * p for r, p in after.items()) - sum(s * p for s, p in units)) < 1e-3
    # each is taken as often as its probability says
    mean = np.zeros(6)
    for _ in range(4000):
        flight = mixing.Flight()
        for row, size in enumerate((3, 10, 10, 7, 50, 1)):
            flight.add(row, size, 0.3, rng.random())
        mean += [dict(flight.settled).get(r, 0) + {q: p for q, _, p in flight.open}.get(r, 0) for r in range(6)]
    assert np.abs(mean / 4000 - 0.3).max() < 0.03

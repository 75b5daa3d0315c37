"""Groups of similar texts against brute force, by kind of edit, and a large group of near copies."""

import os
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmark.llm import common, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def edited(rng, words, kind, n):
    words = list(words)
    if kind == "scattered":
        for k in rng.sample(range(len(words)), n):
            words[k] = f"new{rng.randrange(10**6)}"
    elif kind == "appended":
        words += [f"new{rng.randrange(10**6)}" for _ in range(5 * n)]
    else:
        at = rng.randrange(len(words) - 5 * n)
        words[at : at + 5 * n] = [f"new{rng.randrange(10**6)}" for _ in range(5 * n if kind == "replaced" else 0)]
    return words


KINDS = ("scattered", "appended", "cut", "replaced")


@pytest.mark.parametrize("cell", [2000, 2])
def test_similar_groups(spark, cell):
    rng = random.Random(cell)
    docs = []
    for k in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 250))]
        docs.append(" ".join(base))
        for _ in range(3):
            docs.append(" ".join(edited(rng, base, KINDS[k % 4], rng.randint(0, max(1, len(base) // 30)))))
    docs += ["one two three", "One two  three", "one two", "", " "]
    sets = [shingles(t) for t in docs]
    up = list(range(len(docs)))
    loose = 0

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            loose += 0.6 < share < 0.8
            if share >= 0.8:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert loose > 20
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, cell=cell).collect()}
    assert got == {k: find(k) for k in range(len(docs))}


def test_bands_find_every_kind_of_edit():
    rng = random.Random(7)
    for kind, share in zip(KINDS, (0.02, 0.045, 0.034, 0.018), strict=True):
        for _ in range(60):
            base = [f"w{rng.randrange(10**5)}" for _ in range(rng.randint(200, 500))]
            a, b = (simhash.shingle_set(" ".join(w)) for w in (base, edited(rng, base, kind, round(share * len(base)))))
            shared = len(np.intersect1d(a, b))
            assert 0.78 < shared / (len(a) + len(b) - shared) < 0.88
            assert (simhash.band_keys(simhash.least_hashes(a)) == simhash.band_keys(simhash.least_hashes(b))).any(), kind


def test_template_source(spark, monkeypatch):
    """A source whose texts differ in one number: all are linked through stars, and no pair is left to compare."""
    made = []
    left_over = simhash._left_over
    monkeypatch.setattr(simhash, "_left_over", lambda *a: made.append(left_over(*a)) or made[0])
    words = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join([*words[:100], str(k), *words[100:]])) for k in range(400)] + [(1000 + k, f"other text number {k}") for k in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: 0 if k < 400 else k for k, _ in docs} and made[0].count() == 0


def test_links_within_a_cell_are_fewer_than_components():
    """However many pairs of a cell are similar, its links only join what was apart."""
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.sort(np.where(rng.random(300) < 0.03, rng.integers(0, 2**63, 300, dtype=np.uint64), base)) for _ in range(120)]
    row = lambda k, left: (k, k, len(sets[k]), left, (simhash.least_hashes(sets[k]) & np.uint64(255)).astype(np.uint8).tobytes(), sets[k].tobytes())
    rows = [row(k, False) for k in range(120)] + [row(k, True) for k in range(1, 120)]
    found = simhash._settle(rows, 0.8)
    up = list(range(120))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(120):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            assert simhash._alike(sets[i], sets[j], 0.8) == (shared / (600 - shared) >= 0.8)
            if shared / (600 - shared) >= 0.8:
                up[find(i)] = find(j)
    assert len(found) == 120 - len({find(k) for k in range(120)})
    assert simhash._alike(sets[0][:0], sets[0][:0], 0.8) and not simhash._alike(sets[0], sets[0][:0], 0.8)


@pytest.mark.parametrize("plain", [False, True])
def test_template_below_the_threshold(spark, monkeypatch, plain):
    """Texts of one template, each with an end of its own, at a similarity of 0.71: no group of more than a cell is dealt,
    however many there are. With the bare template beside them, which each is similar to, they are one group."""
    dealt = []
    left_over = simhash._left_over
    monkeypatch.setattr(simhash, "_left_over", lambda mixed, *a: dealt.append(mixed.filter("m > 20").count()) or left_over(mixed, *a))
    words = [f"w{k}" for k in range(200)]
    for n in (150, 300):
        docs = [" ".join([*words, *(f"own{k}x{i}" for i in range(40))]) for k in range(n)] + [" ".join(words)] * plain
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, cell=20).collect()}
        assert got == {k: 0 if plain else k for k in range(len(docs))}
    assert dealt == [0, 0]


def test_settled(spark):
    """The table is there, and of those written on the way none is left."""
    seen = []

    def make():
        seen.append(common.stored(spark.range(9), "way"))
        return seen[0].filter("id > 5")

    got = common.settled(spark, make, "made")
    assert sorted(r["id"] for r in got.collect()) == [6, 7, 8]
    assert seen[0].inputFiles() and not any(os.path.exists(f.removeprefix("file://")) for f in seen[0].inputFiles())


def test_marks_grow_with_the_rows(spark, monkeypatch):
    assert [common.slots_for(n) for n in (0, 1, 1 << 19, (1 << 19) + 1, 10**7, 10**12)] == [1 << 23] * 3 + [1 << 24, 1 << 28, 1 << 30]
    monkeypatch.setattr(common, "SLOTS", 1 << 16)
    docs = spark.range(30_000).withColumnRenamed("id", "doc_id")
    marked = common.with_mark(docs, common.marks(docs.filter("doc_id % 3 = 0")))
    counts = {r[0]: (r[1], r[2]) for r in marked.groupBy(F.col("doc_id") % 3 == 0).agg(F.count_if(common.MARK), F.count("*")).collect()}
    assert counts[True] == (10_000, 10_000) and 0 < counts[False][0] < 0.1 * counts[False][1]


def test_stage_goes_by_fingerprints_and_by_shares(spark):
    """Texts whose fingerprints differ in three bits at most are near copies, also where they share less than 0.8; so are those that
    share 0.8 whatever their fingerprints; and a document that is near one of either kind joins both."""
    rng = random.Random(11)
    line = " ".join(f"w{k}" for k in range(31))
    own = lambda n: " ".join(f"own{rng.randrange(10**9)}" for _ in range(n))
    base = [f"w{rng.randrange(10**5)}" for _ in range(200)]
    texts = {3: " ".join([line] * 40 + [own(15)]), 4: " ".join([line] * 40 + [own(15)]), 7: " ".join(base), 9: " ".join(edited(rng, base, "appended", 7)), 12: own(80)}
    docs = spark.createDataFrame([(k, t, "xa", "s", len(t)) for k, t in texts.items()] + [(None, texts[3], "xa", "s", 1), (12, own(9), "xa", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    prints = {k: simhash.fingerprint(t, 3) for k, t in texts.items()}
    apart = lambda a, b: ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count()
    share = lambda a, b: len(shingles(texts[a]) & shingles(texts[b])) / len(shingles(texts[a]) | shingles(texts[b]))
    assert apart(3, 4) <= 3 and share(3, 4) < 0.8
    assert apart(7, 9) > 3 and share(7, 9) >= 0.8
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 3, 7, 12]


def test_merged_groups(spark):
    """A chain of links of either kind is one group."""
    one = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (7, 5), (8, 8)], "doc_id long, component_id long")
    other = spark.createDataFrame([(1, 1), (2, 2), (5, 2), (7, 7), (8, 8)], "doc_id long, component_id long")
    assert {r["doc_id"]: r["component_id"] for r in simhash.merged_groups(one, other).collect()} == {1: 1, 2: 1, 5: 1, 7: 1}
    assert simhash.merged_groups(one.filter("doc_id = 8")).count() == 0

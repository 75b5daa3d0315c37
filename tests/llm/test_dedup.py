"""Suffix dedup, SimHash groups, components, fingerprints and shards against brute force on small tables."""

import hashlib
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from proofmark.llm import components, fingerprints, sharding, simhash, suffix_dedup


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups_of(n, linked):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                up[find(i)] = find(j)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("split_above", [20_000, 3])
def test_suffix_dedup(spark, monkeypatch, split_above):
    monkeypatch.setattr(suffix_dedup, "SPLIT_ABOVE", split_above)
    rng = random.Random(split_above)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    base = [word(rng.randint(0, 700)) for _ in range(8)]
    docs = []
    for k in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 400)
            parts.append(rng.choice([word(rng.randint(0, 200)), b[a : a + rng.randint(0, 400)], b]))
        docs.append((k, "".join(parts)))
    docs += [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 300), (104, base[0]), (104, base[0]), (106, "x" * 199), (107, "x" * 200), (None, "y" * 300)]
    docs += [(None, word(250) + base[1][:230] * (k % 2)) for k in range(40)]
    bodies = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    want = []
    for (d, _), b in zip(docs, bodies, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        want.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in suffix_dedup.suffix_dedup(df).collect()) == Counter(want)
    clashing = df.selectExpr("doc_id", "text", "1 as n_chars", "'a' as key__", "'b' as places", "'c' as row", "'d' as bucket__", "'e' as marked__")
    cut = suffix_dedup.cut_repeats(clashing)
    assert cut.columns == clashing.columns and cut.count() == len(docs)
    assert all((r["key__"], r["places"], r["row"], r["bucket__"]) == ("a", "b", "c", "d") and r["n_chars"] in (1, len(r["text"] or "")) for r in cut.collect())
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


def fp3(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(1)
    base = [[rng.choice(["the", "cat", "É", "sat", "On", "mat"]) + str(rng.randint(0, 9)) for _ in range(60)] for _ in range(8)]
    docs = []
    for k in range(80):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "new"
        docs.append((k, rng.choice([" ", "\t"]).join(words)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (203, "one two"), (204, "ONE TWO")]
    codes = [fp3(t) for _, t in docs]
    of = groups_of(len(docs), lambda i, j: bin(codes[i] ^ codes[j]).count("1") <= 3)
    least = defaultdict(lambda: 10**9)
    for (d, _), g in zip(docs, of, strict=True):
        least[g] = min(least[g], d)
    want = sorted((d, f"{c:016x}", least[g]) for (d, _), c, g in zip(docs, codes, of, strict=True))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in simhash.simhash_components(df).collect()) == want
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_links_of_clusters(spark):
    rng = np.random.default_rng(0)
    codes = set()
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(60):
            c = base
            for k in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                c ^= 1 << k
            codes.add(c)
    codes = sorted(codes)
    of = groups_of(len(codes), lambda i, j: bin(codes[i] ^ codes[j]).count("1") <= 3)
    least = {}
    for k, g in enumerate(of):
        least[g] = min(least.get(g, k), k)
    df = spark.createDataFrame([(k, signed(c)) for k, c in enumerate(codes)], "doc_id long, fp long")
    for split_above, group in ((20_000, 4096), (16, 50)):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, 3, split_above, group).collect()}
        assert got == {k: least[g] for k, g in enumerate(of)}


def test_gray_index_finds_all():
    rng = np.random.default_rng(2)
    codes = np.unique(np.concatenate([rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 64, 200, dtype=np.uint64)]))
    index = simhash.GrayIndex(codes)
    q, x = index.search(codes, 5)
    got = set(zip(codes[q].tolist(), index.codes[x].tolist(), strict=True))
    assert got == {(a, b) for a in codes.tolist() for b in codes.tolist() if bin(a ^ b).count("1") <= 5}


def test_gray_index_prunes_whole_groups():
    codes = np.random.default_rng(4).integers(0, 2**64, 4096, dtype=np.uint64)
    index = simhash.GrayIndex(codes)
    assert all((p[1:] >= p[:-1]).all() for p in [simhash.gray_rank(index.codes)])
    index.search(codes, 3)
    assert index.compared < 0.25 * len(codes) ** 2


def test_masks_agree_somewhere():
    rng = random.Random(0)
    for n in (10, 100_000, 10**9, 10**14):
        masks = simhash.first_masks(3, n)
        for _ in range(200):
            change = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not change & m for m in masks)
        for m in masks:
            finer = simhash.finer_masks(m, 3)
            change = sum(1 << b for b in rng.sample([b for b in range(64) if not m >> b & 1], 3))
            assert any(not change & f for f in finer) and all(f & m == m for f in finer)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(30)] + [(7, 7), (500, 501), (501, 500)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(61)}) == 1 and len({got[100 + k] for k in range(30)}) == 1
    assert len(set(got.values())) == 3 and got[500] == got[501]


def test_fingerprints(spark):
    rng = random.Random(1)
    words = ["the", "Ab", "é", "É", "ﬁne", "x", "yy", "　", "Straße", "STRASSE", "é", "q"]
    docs = [(k * 7, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    docs += [(5001, None), (5002, ""), (5003, "É X"), (5004, "é  x"), (3, "dup"), (3, "dup"), (3, "other")] + [(6000 + k, "same text everywhere") for k in range(10)]

    def folded(s):
        nfkc = lambda x: unicodedata.normalize("NFKC", x)
        return re.sub(r"\s+", " ", nfkc(nfkc(s).casefold())).strip(" ")

    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0], signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    want, strings = [], {}
    for k, (d, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        want.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), float(folded(edited) == folded(t)), float(folded(after) == folded(t))))
        strings[d, want[-1][2]] = (folded(t), folded(edited))
    got = fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == sorted(want)
    prints = defaultdict(set)
    for r in got:
        own, edited = strings[r["doc_id"], r["edited_sha256"]]
        prints[own].add(r["fingerprint"])
        prints[edited].add(r["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "alone")], "doc_id long, text string")).first()
    assert (one["near_next"], one["near_edited"]) == (1.0, 0.0)


def test_fingerprints_of_rows_without_id(spark):
    docs = [(None, f"Text {k % 50}") for k in range(400)] + [(None, None), (None, ""), (9, "Text 1"), (9, "Text 1"), (9, "text  1")]
    rows = sorted(((-1 if d is None else d, t or "") for d, t in docs), key=lambda r: (r[0], signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    want = []
    for k, (d, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        same = lambda a, b: float(" ".join(a.lower().split()) == " ".join(b.lower().split()))
        want.append((None if d < 0 else d, n, hashlib.sha256(edited.encode()).hexdigest(), same(edited, t), same(after, t)))
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, u1 int, copies int, raw int").repartition(3)
    got = fingerprints.fingerprints(df)
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert fingerprints.fingerprints(df.limit(0)).columns == got.columns and fingerprints.fingerprints(df.limit(0)).count() == 0


def test_shards(spark):
    docs = [(k, f"text {k}") for k in range(3000)] + [(5, None), (None, "x")]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), [1.0] * 24, parts=8).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(rows) == len(docs)
    assert {r["text_crc32"] for r in rows if r["size"] == 8} == {0}
    assert next(r["text_crc32"] for r in rows if r["doc_id"] == 7) == zlib.crc32(b"text 7")
    for r in rows:
        draws = []
        for shard in range(25):
            seed = 42 if r["doc_id"] is None else xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42)
            unit = ((xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11) + 0.5) / 2**53
            draws.append((-math.log(unit), shard))
        assert (r["shard"], r["grown_shard"]) == (min(draws[:24])[1], min(draws)[1])
    same = spark.createDataFrame([(1, "copy", "clash", 3)] * 500 + [(None, "none", "clash", 4)] * 500, "doc_id long, text string, shard string, part int")
    slots = defaultdict(list)
    for r in sharding.shard(same, [1.0] * 4, parts=16).collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 1000 and all(sorted(p) == list(range(len(p))) for p in slots.values())
    assert sharding.shard(same.limit(0), [1.0] * 4).count() == 0
    shares = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), [1.0, 3.0]).groupBy("shard").count().collect()
    assert 0.7 < {r["shard"]: r["count"] for r in shares}[1] / len(docs) < 0.8

"""Pseudonyms, top-k search, language identification, the pipeline's stages, and the edges of each."""

import hmac
import math
import random
from datetime import date, timedelta

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmark.llm import language, pseudonyms, simhash, suffix_dedup, topk

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_permutations():
    of = pseudonyms.Permuter(b"k").of
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(of("x", v, n) for v in range(n)) == list(range(n))


def test_pseudonyms():
    p = pseudonyms.Pseudonyms(b"k")
    text = "a.b42@mail8.example.com +1 (988) 555-2485, 4041894974608795 4041-8949-7460-8795 42.144.35.254. 1987-03-12 12/03/1987 March 12, 1987 123-45-6789 DE89 3704 0044 0532 0130 00"
    new, n = p.replace(text)
    assert n == 10 and p.replace(text) == (new, n)
    words = new.split(" ")
    card, grouped = next(w for w in words if w.isdigit() and len(w) == 16), next(w for w in words if w.count("-") == 3)
    assert pseudonyms.luhn(card) and card == grouped.replace("-", "") != "4041894974608795"
    for clean in ("300.1.1.1", "4041894974608796", "2023-13-40", "version 3.14 of 2024", "1.2.3", "000-12-3456", "no numbers", ""):
        assert p.replace(clean) == (clean, 0)
    again = pseudonyms.Pseudonyms(b"other").replace(text)[0]
    assert again != new


def plain_feistel(key, name, value, n):
    """The network written out: ten rounds that add a digest of one half to the other, again until the value is in range."""
    a = math.isqrt(n - 1) + 1
    b = math.ceil(n / a)
    while True:
        high, low = value // b, value % b
        for k in range(10):
            half = low if k % 2 == 0 else high
            add = int(hmac.new(key, f"{name}/{n}/{k}/{half}".encode(), "sha256").hexdigest(), 16)
            high, low = ((high + add) % a, low) if k % 2 == 0 else (high, (low + add) % b)
        value = high * b + low
        if value < n:
            return value


def test_pseudonyms_against_a_plain_network():
    p = pseudonyms.Pseudonyms(b"some key")
    rng = random.Random(5)
    for _ in range(100):
        parts = [rng.randint(0, 255) for _ in range(4)]
        number = plain_feistel(b"some key", "ip", sum(v << 8 * (3 - k) for k, v in enumerate(parts)), 2**32)
        assert p.replace(".".join(map(str, parts)))[0] == ".".join(str(number >> 8 * k & 255) for k in (3, 2, 1, 0))
        digits = str(rng.randint(2, 9)) + "".join(rng.choice("0123456789") for _ in range(9))
        new = plain_feistel(b"some key", "phone210", int(digits) - 2 * 10**9, 8 * 10**9) + 2 * 10**9
        assert p.replace(f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}")[0] == f"+1 ({str(new)[:3]}) {str(new)[3:6]}-{str(new)[6:]}"
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        new = f"{plain_feistel(b'some key', 'secret' + 'x' * 40, int(token, 16), 16**40):040x}"
        if any(c.isdigit() for c in token):
            assert p.replace(f'token = "{token}"')[0] == f'token = "{new}"'
    days = [d for k in range(73049) if (d := date(1900, 1, 1) + timedelta(k)).month < 10 and d.day < 10]
    for k in rng.sample(range(len(days)), 50):
        new = days[plain_feistel(b"some key", "dateFalseFalse", k, len(days))]
        assert p.replace(days[k].isoformat())[0] == new.isoformat()


def test_equal_values_stay_linked_and_formats_keep_their_width():
    p = pseudonyms.Pseudonyms(b"k")
    of = lambda t: p.replace(t)[0]
    only = lambda t: "".join(c for c in t if c.isdigit())
    phones = ["+49 30 12345678", "+493012345678", "+49-30-1234-5678"]
    assert len({only(of(t)) for t in phones}) == 1 and all(of(t) != t and of(t)[:3] == "+49" for t in phones)
    assert only(of("+1 988 555 2485"))[1:] == only(of("(988) 555-2485"))
    new = date.fromisoformat(of("2020-03-07"))
    assert (of("2020-3-7"), of("7/3/2020"), of("07.03.2020")) == (f"{new.year}-{new.month}-{new.day}", f"{new.day}/{new.month}/{new.year}", f"{new.day:02}.{new.month:02}.{new.year}")
    assert new.month < 10 and new.day < 10 and new != date(2020, 3, 7)
    months = pseudonyms.Pseudonyms.MONTHS
    new = date.fromisoformat(of("1987-03-12"))
    for text, want in (
        ("March 12, 1987", f"{months['en'][new.month - 1]} {new.day}, {new.year}"), ("12 March 1987", f"{new.day} {months['en'][new.month - 1]} {new.year}"), ("12. März 1987", f"{new.day}. {months['de'][new.month - 1]} {new.year}"),
        ("12 mars 1987", f"{new.day} {months['fr'][new.month - 1]} {new.year}"), ("12 de marzo de 1987", f"{new.day} de {months['es'][new.month - 1]} de {new.year}"), ("12 MARS 1987", f"{new.day} {months['fr'][new.month - 1].upper()} {new.year}"),
    ):
        assert of(text) == want, text
    assert of("1er mars 1987") == of("1 mars 1987") != "1er mars 1987" and of("31. Februar 1987") == "31. Februar 1987"
    assert of("token: internationalisation") == "token: internationalisation"
    assert len(of("api_key='Ab3-xy9_0123456789zz'")) == 30 and of("api_key='Ab3-xy9_0123456789zz'") != "api_key='Ab3-xy9_0123456789zz'"
    assert len({of(f"+1 {k:010d}") for k in range(0, 5 * 10**9, 10**8 + 7)}) == 50


def test_key_of_the_session(spark):
    """A session without a key draws one and keeps it; a given key is the key."""
    one, other = spark.newSession(), spark.newSession()
    assert pseudonyms.key_of(one) == pseudonyms.key_of(one) != pseudonyms.key_of(other) and len(pseudonyms.key_of(one)) >= 32
    other.conf.set(pseudonyms.KEY_SETTING, "k")
    assert pseudonyms.key_of(other) == b"k"


def test_pseudonyms_table(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "ip 10.0.0.1", "c"), (3, "ip 10.0.0.1", "c")], "doc_id long, text string, n string")
    rows = sorted(tuple("~" if v is None else v for v in r) for r in pseudonyms.pseudonymise(df, b"k").select("doc_id", "n", "text", "n_replaced").collect())
    assert rows[0] == (1, "a", "~", 0) and rows[1] == (2, "b", "", 0) and rows[2] == rows[3] and rows[2][2] != "ip 10.0.0.1"


@pytest.mark.parametrize("block", [8192, 15])
def test_top_k(spark, block):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 64)) * 0.1
    rows = [(k, [float(np.float32(x)) for x in base[k % 6] + rng.normal(size=64) * 0.08]) for k in range(500)]
    rows += [(2000, None), (2001, [None] * 64), (2020, [float("nan")] * 64), (2040, [1.0, 2.0]), (2041, [3.0, -2.0]), (2060, []), (None, [0.1] * 64), (2080, [0.0] * 64), (2081, [0.0] * 64), (2082, [float("inf")] * 64)]
    whole = [(k, [math.floor(64 * x) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for k, q in whole:
        if k % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != k and len(v) == len(q))[:20]
            want += [(k, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(df.withColumn("cell", F.lit(1)), query_block=block, candidate_block=10 * block).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_repeated_ids(spark):
    """A repeated candidate counts as often as it is there, a repeated query once."""
    rows = [(20, [1.0, 0.0])] * 3 + [(21, [1.0, 1.0])] * 4 + [(40, [0.0, 1.0]), (40, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, query_block=2, candidate_block=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == (
        [(20, n, 21, 4096) for n in range(1, 5)] + [(20, 5, 40, 0)] + [(40, n, 21, 4096) for n in range(1, 5)] + [(40, 5, 20, 0)]
    )


def test_bounds_prune():
    """Of clustered vectors over nine tenths of the pairs go by their bounds alone, of uniform ones still over a half, and no result with them."""
    rng = np.random.default_rng(1)
    clustered = rng.normal(size=(30, 64))[rng.integers(30, size=8000)] + 0.15 * rng.normal(size=(8000, 64))
    for x, most in ((clustered, 0.1), (rng.normal(size=(8000, 64)), 0.5)):
        x = np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None])
        best = topk.Best(np.arange(0, 8000, 20), x[::20], 20)
        best.add(np.arange(8000), x)
        scores = x[::20] @ x.T
        scores[np.arange(400), np.arange(0, 8000, 20)] = -np.inf
        assert (best.score == -np.sort(-scores, axis=1)[:, :20].ravel()).all()
        assert best.scored / best.pairs < most


WORDS = {"en": "the and of thing with this that other", "de": "der und nicht über schön größe straße ein", "es": "el niño señor canción que más año de"}


def _docs(n=240):
    rng = random.Random(0)
    rows = []
    for k in range(n):
        lang = list(WORDS)[k % 3]
        rows.append((k, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(5, 60))), lang, "s", 0))
    return rows


def test_language(spark):
    rows = [*_docs(), (900, None, "en", "s", 0), (901, "123 !!", None, "s", 0), (902, "", "de", "s", 0), (None, "the other thing", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = language.identify(df, language.train(df)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all((by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0) for k in (900, 901, 902))
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert held and sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in held) / len(held) > 0.95
    unlabelled = language.train(spark.createDataFrame([(1, "abc", None, "s", 3)], DOCUMENTS))
    assert unlabelled is None and language.predict(unlabelled, ["abc"]) == [("und", 0.0, False)]


def test_stages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    prose = [" ".join(word() for _ in range(150)) for _ in range(12)]
    near = prose[0].split()
    near[70] = "changed"
    passage = " ".join(word() for _ in range(60))
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(prose)]
    rows += [(50, " ".join(near), "en", "s", 0), (51, prose[1], "en", "s", 0), (52, prose[2][:500] + " " + passage, "en", "s", 0), (53, passage + prose[3][:90], "en", "s", 0), (54, None, "en", "s", 0), (55, "12 34", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    keep = dict(corpus_pipeline.STAGES)
    assert {r["doc_id"] for r in keep["language"](spark, docs, "").collect()} == {k for k, *_ in rows} - {54, 55}
    left = keep["near_copies"](spark, docs, "")
    assert left.columns == docs.columns
    assert {k for k in range(12)} <= {r["doc_id"] for r in left.collect()} and not {50, 51} & {r["doc_id"] for r in left.collect()}
    cut = {r["doc_id"]: r for r in keep["repeats"](spark, docs.filter("doc_id in (4, 52, 53)"), "").collect()}
    assert cut[4]["text"] == prose[4] and passage not in cut[52]["text"] and cut[53]["text"] == prose[3][:90] and cut[53]["n_chars"] == 90
    hidden = keep["personal_data"](spark, spark.createDataFrame([(1, "at 10.2.3.4", "en", "s", 11)], DOCUMENTS), "").first()
    assert hidden["text"].startswith("at ") and hidden["text"] != "at 10.2.3.4" and hidden["n_chars"] == len(hidden["text"])
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_repeated_ids_and_nulls(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "s", 1)] * 2 + [(None, "one two three four five six", "en", "s", 1), (2, None, None, None, None)], DOCUMENTS)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == ["1", "2", "None"]
    assert suffix_dedup.cut_repeats(docs).count() == 4
    assert simhash.similar_groups(docs).count() == 3


def test_top_k_beyond_doubles(spark):
    """Scores that doubles can't tell apart."""
    rng = random.Random(9)
    vectors = [(k, [float(rng.randrange(2**24)) + rng.randrange(64) / 64 for _ in range(3)]) for k in range(80)]
    vectors += [(100, [2.0**24, 1.0, 0.0]), (101, [2.0**24, 1.0 + 1 / 64, 0.0])]
    want = []
    ints = {k: [math.floor(64 * x) for x in v] for k, v in vectors}
    for q in (k for k in ints if k % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[k], strict=True)), k) for k in ints if k != q)[:20]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(scores, 1)]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and max(r["score"] for r in got) > 2**53

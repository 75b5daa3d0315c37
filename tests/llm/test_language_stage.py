"""The language stage without labels, and training on many of them."""

import random

import corpus_pipeline
import numpy as np

from proofmark.llm import language

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_without_labels(spark):
    rows = [(1, "clean text", None, "s", 10), (2, "чистый", None, None, None), (None, "no id", None, "s", 5), (4, None, None, "s", 0), (5, "12 !", None, "s", 4)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    assert {r["text"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {"clean text", "чистый", "no id"}


def test_stage_rejects_what_is_no_language(spark):
    """Hexadecimal, random letters and other noise go; mixed, short and foreign texts and those with columns of any name stay."""
    rng = random.Random(5)
    syllables = {"xa": ["ta", "ri", "mo", "ne", "sul"], "xb": ["öch", "ung", "ver", "zei", "tep"], "xc": ["éau", "oui", "que", "lon", "çai"]}
    prose = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    noise = {5000: rng.randbytes(300).hex(), 5001: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(700)), 5002: "".join(chr(rng.randint(33, 126)) for _ in range(900))}
    kept = {6000: "ta", 6001: "Q.", 6002: prose("xa", 80) + noise[5000] + prose("xb", 60), 6003: prose("xa", 20) + " " + prose("xc", 20), 6004: "x" * 40}
    clean = {k: prose(lang, rng.randint(3, 160)) for k, lang in enumerate(sorted(syllables) * 400)}
    labels = {k: sorted(syllables)[k % 3] for k in clean}
    rows = [(k, t, labels.get(k), "s", len(t), "f", True, 0.5) for k, t in {**clean, **noise, **kept}.items()]
    docs = spark.createDataFrame(rows, DOCUMENTS + ", found string, accepted boolean, score double")
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {*clean, *kept}
    assert corpus_pipeline.identify_language(spark, docs.limit(0), "").count() == 0


def test_many_languages(spark):
    rows = [(k, f"text number {k} of its own", f"l{k % 70:02}", "s", 0) for k in range(700)]
    rows += [(None, "no id at all", "zz", "s", 0)] * 3
    net = language.train(spark.createDataFrame(rows, DOCUMENTS).repartition(3))
    assert net.languages == [f"l{k:02}" for k in range(70)] + ["zz"]
    less = language.train(spark.createDataFrame([(1, "é" * 5000, "a", "s", 0)] * 50, DOCUMENTS), rows_per_language=4)
    assert less.languages == ["a"]


def plain_log_probabilities(net, window):
    """The network one place and one filter at a time."""
    widths = [w for w in language.WIDTHS for _ in range(language.FILTERS)]
    pooled = []
    for k, width in enumerate(widths):
        best = -np.inf
        for at in range(len(window)):
            made = 0.0
            for j in range(width):
                byte = window[at + j] if at + j < len(window) else language.PAD
                for e in range(language.EMBEDDING):
                    made += float(net.embedding[byte, e]) * float(net.filters[j * language.EMBEDDING + e, k])
            best = max(best, made)
        pooled.append(max(0.0, best + float(net.bias[k])))
    score = [sum(p * float(net.out[k, y]) for k, p in enumerate(pooled)) + float(net.out_bias[y]) for y in range(len(net.languages))]
    most = max(score)
    return [s - most - np.log(sum(np.exp(x - most) for x in score)) for s in score]


def test_network_against_a_plain_convolution():
    net = language.Network.new(["a", "b", "c"])
    windows = np.random.default_rng(1).integers(0, 257, (3, 24)).astype(np.int16)
    got = net.log_probabilities(windows)
    for w, row in zip(windows.tolist(), got, strict=True):
        assert np.allclose(row, plain_log_probabilities(net, w), atol=1e-4)


def test_gradients_against_differences():
    net = language.Network.new(["a", "b", "c"])
    for name in ("embedding", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias += 0.1
    rng = np.random.default_rng(2)
    windows, target, weight = rng.integers(0, 256, (4, 20)).astype(np.int16), np.array([0, 1, 2, 1]), np.array([1.0, 0.5, 2.0, 0.5])

    def inputs(w):
        padded = np.concatenate([w, np.full((len(w), max(language.WIDTHS) - 1), language.PAD, w.dtype)], axis=1)
        flat = net.embedding[padded]
        return np.stack([flat[:, k : k + max(language.WIDTHS)].reshape(len(w), -1) for k in range(w.shape[1])], axis=1)

    net._inputs = inputs  # in doubles, for differences
    loss = lambda: float(-(net.log_probabilities(windows)[np.arange(4), target] * weight).mean())
    for p, g in zip(net.parameters(), net.gradients(windows, target, weight), strict=True):
        for place in [tuple(int(x) for x in np.unravel_index(k, p.shape)) for k in rng.choice(p.size, min(20, p.size), replace=False)]:
            if p is net.filters and not net.used()[place]:
                continue
            before = p[place]
            p[place] = before + 1e-6
            up = loss()
            p[place] = before - 1e-6
            down = loss()
            p[place] = before
            assert abs((up - down) / 2e-6 - g[place]) < 1e-4, place

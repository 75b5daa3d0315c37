"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Bytes are embedded; filters of several widths, max pooling over a window of fixed length and a softmax give a window's
languages. A text is all its windows: their log probabilities are averaged.

One more output says that a window is of no language. It is learned from windows that are none: those of labelled texts
with their characters in random order, and strings of random, hexadecimal or repeated characters. A text is of no language
if all its windows of 64 bytes or more are, by more than any labelled window of the sample. Shorter texts can't be told.
"""

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Labelled rows of each language that training reads at most, and windows of each such text.
ROWS_PER_LANGUAGE, WINDOWS_PER_TEXT = 600, 4
EPOCHS, BATCH, RATE = 6, 64, 0.004
PAD = 256
#: Windows that the network takes at once: what they make stays in a core's cache.
CHUNK = 48
#: Windows of no language for each labelled one, and the bytes that a window must have to be told to be one.
OUTSIDE_SHARE, OUTSIDE_BYTES = 0.3, 64
#: How far, in log odds, a window has to be beyond every labelled window of the sample to be of no language.
MARGIN = 6.0


@dataclass
class Network:
    """languages, and the weights: embedding, all filters as one matrix (narrow ones end in zeros), and the last layer, with
    a further output for no language if there is a limit: log odds over which a window counts as of none."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    limit: float | None = None

    @classmethod
    def new(cls, languages: list[str], seed: int = 7, outside: bool = False) -> "Network":
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        filters = f32(max(WIDTHS) * EMBEDDING, n, scale=(max(WIDTHS) * EMBEDDING) ** -0.5) * cls.used()
        outputs = len(languages) + outside
        return cls(languages, f32(PAD + 1, EMBEDDING, scale=0.5), filters, np.zeros(n, np.float32), f32(n, outputs, scale=0.2), np.zeros(outputs, np.float32), float("inf") if outside else None)

    @staticmethod
    def used() -> np.ndarray:
        """1 where a filter has a weight, 0 past its width."""
        return np.concatenate([np.repeat((np.arange(max(WIDTHS) * EMBEDDING) < w * EMBEDDING)[:, None], FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)

    def _inputs(self, windows: np.ndarray) -> np.ndarray:
        """At each place of each window the embeddings of as many bytes as the widest filter has."""
        n, size = windows.shape
        padded = np.concatenate([windows, np.full((n, max(WIDTHS) - 1), PAD, windows.dtype)], axis=1)
        flat = self.embedding[padded].reshape(n, -1)
        return np.lib.stride_tricks.as_strided(flat, (n, size, max(WIDTHS) * EMBEDDING), (flat.strides[0], EMBEDDING * 4, 4))

    def _made(self, inputs: np.ndarray) -> np.ndarray:
        n, size, width = inputs.shape
        return (inputs.reshape(n * size, width) @ self.filters).reshape(n, size, -1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self._made(self._inputs(windows)).max(axis=1) + self.bias, 0)
        score = pooled @ self.out + self.out_bias
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))

    def judge(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the languages, given that it is one, and the log odds that it is none."""
        logs = self.log_probabilities(windows)
        n = len(self.languages)
        known = np.logaddexp.reduce(logs[:, :n], axis=1)
        none = logs[:, n] - known if logs.shape[1] > n else np.full(len(logs), -np.inf)
        return logs[:, :n] - known[:, None], none

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    def gradients(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        inputs = self._inputs(windows)
        made = self._made(inputs)
        at, best = made.argmax(axis=1), made.max(axis=1) + self.bias
        pooled = np.maximum(best, 0)
        score = pooled @ self.out + self.out_bias
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(target)), target] -= 1
        p *= (weight / len(target))[:, None]
        d = (p @ self.out.T) * (best > 0)
        rows = np.arange(len(windows))[:, None]
        picked = inputs[rows, at]  # window, filter, inputs of the place of the largest value
        d_filters = np.einsum("nf,nfi->if", d, picked) * self.used()
        to_input = (d[:, :, None] * self.filters.T[None]).reshape(*d.shape, max(WIDTHS), EMBEDDING)
        padded = np.concatenate([windows, np.full((len(windows), max(WIDTHS) - 1), PAD, windows.dtype)], axis=1)
        d_embedding = np.zeros_like(self.embedding)
        for j in range(max(WIDTHS)):
            np.add.at(d_embedding, padded[rows, at + j], to_input[:, :, j])
        return [d_embedding, d_filters, d.sum(axis=0), pooled.T @ p, p.sum(axis=0)]


def windows_of(body: bytes) -> np.ndarray:
    """The whole text in windows of fixed length, the last one padded."""
    n = -(-len(body) // WINDOW)
    out = np.full(n * WINDOW, PAD, dtype=np.int16)
    out[: len(body)] = np.frombuffer(body, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def picked(text: str) -> list[bytes]:
    """The windows of a text that training reads, chosen by the text alone, as 16-bit places."""
    body = text.encode("utf-8", "surrogatepass")
    all_ = windows_of(body)
    if len(all_) > WINDOWS_PER_TEXT:
        all_ = all_[np.random.default_rng(zlib.crc32(body)).permutation(len(all_))[:WINDOWS_PER_TEXT]]
    return [w.tobytes() for w in all_]


def _telling(windows: np.ndarray) -> np.ndarray:
    """Which windows have bytes enough to be told to be of no language."""
    return windows[:, OUTSIDE_BYTES - 1] != PAD


def _outside(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows of no language, a share of the labelled ones that are long enough."""
    long = np.flatnonzero(_telling(windows))
    out = []
    for k, row in enumerate(rng.choice(long, int(len(long) * OUTSIDE_SHARE), replace=False) if len(long) else []):
        body = windows[row][windows[row] != PAD].astype(np.uint8)
        size = int(rng.integers(OUTSIDE_BYTES, len(body) + 1))
        if k % 2 == 0:
            letters = np.array(list(body.tobytes().decode("utf-8", "ignore")))
            made = "".join(rng.permutation(letters)).encode()
        elif k % 8 == 1:
            made = rng.integers(33, 127, size).astype(np.uint8).tobytes()
        elif k % 8 == 3:
            made = rng.bytes(size).hex().encode()
        elif k % 8 == 5:
            made = rng.integers(97, 123, size).astype(np.uint8).tobytes()
        else:
            made = rng.integers(33, 127, int(rng.integers(1, 7))).astype(np.uint8).tobytes() * size
        out.append(windows_of(made[: len(body)])[:1])
    return np.concatenate(out) if out else np.zeros((0, WINDOW), np.int16)


def fit(rows: list[tuple[bytes, str]], seed: int = 7) -> Network | None:
    """A network from (window, language) pairs, by Adam; None without any. The result depends on the rows and the seed only."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    number = {lang: k for k, lang in enumerate(languages)}
    rows = sorted(rows)
    x = np.frombuffer(b"".join(w for w, _ in rows), np.int16).reshape(-1, WINDOW)
    y = np.array([number[lang] for _, lang in rows])
    labelled = x
    none = _outside(x, rng)
    x, y = np.concatenate([x, none]), np.concatenate([y, np.full(len(none), len(languages))])
    counts = np.bincount(y)
    weight = (len(y) / np.maximum(counts, 1) / len(counts)).astype(np.float32)
    net = Network.new(languages, seed, outside=len(none) > 0)
    net.embedding[PAD] = 0
    means = [np.zeros_like(p) for p in net.parameters()]
    squares = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            part = order[at : at + BATCH]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for p, g, m, v in zip(net.parameters(), net.gradients(x[part], y[part], weight[y[part]]), means, squares, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(none):
        labelled = labelled[_telling(labelled)]
        net.limit = MARGIN + max(0.0, *(float(net.judge(labelled[k : k + CHUNK])[1].max()) for k in range(0, len(labelled), CHUNK)))
    return net


_letter = regex.compile(r"\p{L}").search


def predict(net: Network | None, batch: list[str | None]) -> list[tuple[str, float, bool]]:
    """Language and score of whole texts, `und` and 0 without a letter, and whether a text is of a language: that it has a
    letter, and that the network does not hold all its windows for ones of no language."""
    out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, False)] * len(batch)
    if net is None:
        return out

    def settle(group: list[int], parts: list[np.ndarray]) -> None:
        all_ = np.concatenate(parts)
        logs, none = (np.concatenate(c) for c in zip(*(net.judge(all_[k : k + CHUNK]) for k in range(0, len(all_), CHUNK)), strict=True))
        none[~_telling(all_)] = np.inf
        told = np.array([_telling(p).any() for p in parts])
        starts = np.cumsum([0, *(len(p) for p in parts)])
        for k, row in enumerate(group):
            mean = logs[starts[k] : starts[k + 1]].mean(axis=0, dtype=np.float64)
            p = np.exp(mean - mean.max())
            best = int(p.argmax())
            accepted = net.limit is None or not told[k] or bool((none[starts[k] : starts[k + 1]] <= net.limit).any())
            out[row] = (net.languages[best], float(p[best] / p.sum()), accepted)

    group, parts, held = [], [], 0
    for row, text in enumerate(batch):
        if text is None or not _letter(text):
            continue
        w = windows_of(text.encode("utf-8", "surrogatepass"))
        group.append(row)
        parts.append(w)
        held += len(w)
        if held >= 2048:
            settle(group, parts)
            group, parts, held = [], [], 0
    if group:
        settle(group, parts)
    return out


def held_out() -> Column:
    """Documents whose crc32 of doc_id leaves 2 when divided by 4: training does not read them. A missing id is not one."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(w, lang) for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) for w in picked(text)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([lang for _, lang in found], pa.string())], names=["window", "lang"])


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Network | None:
    """A network from labelled rows outside the held-out part: of each language those whose doc_id hashes least, at most
    `rows_per_language` of them. That sample is bounded; the languages are all that have such rows, however many."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.withColumn("h", F.xxhash64("doc_id"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("low"))
    # twice the rows wanted, so that no task gets all rows of a language; the least is there even if all have one doc_id
    few = (F.col("h") / F.lit(2.0**64) + 0.5 <= F.lit(2.0 * rows_per_language + 100) / F.col("n")) | (F.col("h") == F.col("low"))
    near = rows.join(F.broadcast(counts), "lang").filter(few)
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    sample = near.withColumn("nth", nth).filter(F.col("nth") <= rows_per_language).select("text", "lang")
    return fit([(bytes(r["window"]), r["lang"]) for r in sample.mapInArrow(_windows, "window binary, lang string").collect()])


def _predicted(net: Network | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = predict(net, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    return run


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each row of `docs`, from the whole text alone.

    A null text, one without a letter, or any text if nothing could be learned, is `und` with score 0 and not accepted, nor
    is a text all of whose windows are of no language; it has the learned language it is most like all the same. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predicted(net), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def with_letter(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that have a text with a letter in it."""

    @F.pandas_udf("boolean")
    def found(text: pd.Series) -> pd.Series:
        return pd.Series([t is not None and _letter(t) is not None for t in text], dtype=bool)

    return docs.filter(found("text"))


def of_a_language(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of `docs` whose text the network accepts as of a language, with their own columns, whatever their names."""

    @F.pandas_udf("boolean")
    def accepted(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in series:
            yield pd.Series([g[2] for g in predict(net, list(text))], dtype=bool)
        release()

    return docs.filter(accepted("text"))

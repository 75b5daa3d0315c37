"""Exact token counts of every prefix of a text, by dynamic programming over last tokens.

The count at a prefix is one more than the count where its last token starts. Word borders that no token crosses split a
text, so a prefix's count is the count up to its word plus the count within the word. What a whole word costs is worked out
once for each distinct word and kept, which answers "how many tokens" and "over the limit?"; the prefixes of the one word
in which a budget ends are worked out where "how much fits?" asks for them.
"""

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UNKNOWN, BpeTable, last_tokens
from .common import sliced, texts

SPACE = "▁"
LIMIT = 4096
#: Distinct words that a worker keeps; a full store is emptied, which costs time and no result.
KEPT_WORDS = 900_000


def piece_table(model: str) -> tuple[BpeTable, dict[str, int]]:
    """The merges of a sentencepiece BPE model, and what a symbol without a piece of its own costs in byte tokens."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
    made = sorted((p for p in score if len(p) > 1), key=lambda p: -score[p])
    whole = lambda p: len(p) == 1 or p in score
    merges = [(p[:k], p[k:]) for p in made for k in range(1, len(p)) if whole(p[:k]) and whole(p[k:])]
    lowest = min((score[p] for p in made), default=0.0)
    late = [p for p in made if score[p] == lowest] if sum(score[p] == lowest for p in made) > 1 else []
    symbols = dict.fromkeys(c for p in score for c in p)
    return BpeTable(symbols, merges, late), {c: len(c.encode()) for c in symbols if c not in score}


class PrefixCounter:
    """Token counts of texts and their prefixes under one sentencepiece model that adds a space before the text."""

    def __init__(self, model: str) -> None:
        self.table, self.bytes_of = piece_table(model)
        self.pairs = {t[k : k + 2] for t in self.table.number for k in range(len(t) - 1)}
        if any(p[1] == SPACE != p[0] for p in self.pairs):
            raise ValueError("a token goes on past a space: words can't be counted apart")
        self.parts = regex.compile(r"[\p{L}\p{M}\p{N}▁]+|[^\p{L}\p{M}\p{N}▁]+").findall
        self.words = regex.compile(r"▁+[^▁]*").findall
        self.total: dict[str, int] = {}
        self.count: dict[str, int] = {}

    def _parts(self, word: str) -> list[str]:
        """Pieces of a word between which no token reaches."""
        out: list[str] = []
        for part in self.parts(word):
            if out and out[-1][-1] + part[0] in self.pairs:
                out[-1] += part
            else:
                out.append(part)
        return out

    def _within(self, part: str) -> np.ndarray:
        """The token counts of the prefixes of one part."""
        _, last, count = next(last_tokens(self.table, [part]))
        return np.array(count[1:], dtype=np.int64) + np.cumsum(self._extra(part, last))

    def _extra(self, part: str, last: list[int]) -> list[int]:
        """Tokens beyond one that each symbol costs: bytes stand for a symbol that no token has, and nothing spans it."""
        return [len(c.encode("utf-8", "surrogatepass")) - 1 if t < 0 or c in self.bytes_of and t < self.table.n_base else 0 for c, t in zip(part, last[1:], strict=True)]

    def _count(self, words: set[str]) -> None:
        whole, parts = [], {}
        for w in words:
            core = w.rstrip(".,;:!?\n")
            if core[1:].isalnum() and (core == w or core[-1] + w[len(core)] not in self.pairs):
                if core == w:
                    whole.append(w)
                else:
                    parts[w] = (core, w[len(core) :])
            else:
                parts[w] = self._parts(w)
        for part, last, count in last_tokens(self.table, {*whole, *(p for ps in parts.values() for p in ps)} - self.count.keys()):
            self.count[part] = count[-1] + (sum(self._extra(part, last)) if self.bytes_of or UNKNOWN in last[1:] else 0)
        known = self.count
        for w in whole:
            self.total[w[1:]] = known[w]
        for w, ps in parts.items():
            self.total[w[1:]] = sum([known[p] for p in ps])

    def split(self, text: str) -> list[str]:
        """The words of a text, each without the first of the spaces before it."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] for w in self.words(SPACE + text.replace(" ", SPACE))]

    def totals(self, batch: list[str]) -> list[list[int]]:
        """For each text the token counts of its words."""
        if len(self.total) > KEPT_WORDS:
            self.total.clear()
            self.count.clear()
        get, split = self.total.get, [self.split(t) for t in batch]
        counts = [list(map(get, words)) for words in split]
        missed = [k for k, c in enumerate(counts) if None in c]
        if missed:
            self._count({SPACE + w for k in missed for w, c in zip(split[k], counts[k], strict=True) if c is None})
            for k in missed:
                counts[k] = list(map(get, split[k]))
        return counts

    def fit(self, text: str, counts: list[int], budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens."""
        ends = list(accumulate(counts))
        k = int(np.searchsorted(ends, budget, side="right"))
        words = self.split(text)
        if k == len(words):
            return len(text)
        written = [SPACE + w for w in words]
        chars = sum(map(len, written[:k]))
        room, inside = budget - (ends[k - 1] if k else 0), 0
        most = done = 0
        for part in self._parts(written[k]):
            now = inside + self._within(part)
            if (fits := np.flatnonzero(now <= room)).size:
                most = done + int(fits[-1]) + 1
            inside, done = int(now[-1]), done + len(part)
        return max(0, chars + most - 1)  # the space before the text is none of its own

    def prefix_counts(self, text: str) -> np.ndarray:
        """The token counts of the prefixes of 1, 2, ... code points."""
        out, before = [], 0
        for w in self.split(text):
            for part in self._parts(SPACE + w):
                out.append(before + self._within(part))
                before = int(out[-1][-1])
        return np.concatenate(out)[1:] if out else np.zeros(0, dtype=np.int64)


_counters: dict[str, PrefixCounter] = {}


def _counter(model: str) -> PrefixCounter:
    if model not in _counters:
        _counters[model] = PrefixCounter(model)
    return _counters[model]


def _each(model: str, budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in sliced(batches):
            rows = batch.column("text").to_pylist()
            counts = counter.totals(rows)
            n = [sum(c) for c in counts]
            fit = [len(t) if k <= budget else counter.fit(t, c, budget) for t, c, k in zip(rows, counts, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([k > budget for k in n]), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return run


def token_counts(docs: DataFrame, model: str, budget: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > budget), fit_chars (code points of the longest prefix within it).

    Reads doc_id and text; one row for each row of `docs`, repeated ones too, other columns are left out. A null or
    empty text has 0 bytes and 0 tokens. Texts of any length are counted whole. No shuffle.
    """
    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(_each(model, budget), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and counts: the tokens of the prefix of 1, 2, ... code points. A null or empty text has an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in sliced(batches):
            counts = [counter.prefix_counts(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "counts"])

    return texts(docs).mapInArrow(run, "doc_id long, counts array<long>")

"""Encoding and decoding with a word BPE vocabulary: a walk over the trie of the distinct words.

The distinct words of a batch, sorted, are a trie in depth-first order; `last_tokens` goes down it and works out the
last token of each prefix once, however many words share it. Words met before are looked up.
"""

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import BpeTable, last_tokens, path
from .common import sliced, texts

#: Distinct chunks of text that a worker keeps; a full store is emptied, which costs time and no result.
KEPT_CHUNKS = 400_000
#: A word's last symbol is another than the same symbol inside it: it is moved up by so many code points.
END = 0x1000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + other.index(b)) for b in range(256)]


class WordCodec:
    """What the tokenizer file does to a text, for files of this kind: words with a marked end, lower case, no decoder."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [s["type"] for s in steps] + [s["type"] for s in pre] + [spec["decoder"], model["continuing_subword_prefix"], model["dropout"]]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel", None, None, None] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"not a word BPE tokenizer of the kind this codec follows: {kinds}")
        self.suffix = model["end_of_word_suffix"]
        plain = lambda t: t[: -len(self.suffix) - 1] + chr(ord(t[-len(self.suffix) - 1]) + END) if t.endswith(self.suffix) else t
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.symbols = byte_symbols()
        base = [*self.symbols, *(chr(ord(s) + END) for s in self.symbols)]
        self.table = BpeTable(base, [(plain(a), plain(b)) for a, b in merges])
        shown = [t[:-1] + chr(ord(t[-1]) - END) + self.suffix if ord(t[-1]) >= END else t for t in self.table.token]
        self.shown = [t.encode() for t in shown]
        self.ids = [model["vocab"][t] for t in shown]
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        self.special = {t["content"]: (t["id"].to_bytes(4, "little"), t["content"].encode()) for t in spec["added_tokens"]}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(pre[0]["pattern"]["Regex"]).findall
        self.spaces = re.compile("[\t\n\v\f\r \x85\xa0  -     　]+")
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.kept_words: dict[str, tuple[bytes, bytes]] = {}

    def _chunks(self, text: str) -> list[str]:
        """The normalized text at its white space, and special strings as they are."""
        if "<|" in text:
            out = []
            for k, part in enumerate(self.apart.split(text)):
                out += [part] if k % 2 else ["\0" + c if c in self.special else c for c in self._plain_chunks(part)]
            return out
        return self._plain_chunks(text)

    def _plain_chunks(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in self.spaces.split(text) if c]
        return text.split()

    def _learn(self, chunks: set[str]) -> None:
        if len(self.kept_words) > KEPT_CHUNKS:
            self.kept_words.clear()
        parts = {c: [c] if c.isalpha() else self.words(c.removeprefix("\0") if c[1:] in self.special else c) for c in chunks if c not in self.special}
        self._walk({w for ws in parts.values() for w in ws} - self.kept_words.keys())
        for c in chunks:
            if c in self.special:
                self.kept[c] = self.special[c]
            else:
                found = [self.kept_words[w] for w in parts[c]]
                self.kept[c] = found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), b" ".join([f[1] for f in found if f[1]]))

    def _walk(self, words: set[str]) -> None:
        spelled = {}
        for w in words:
            s = w if w.isascii() else "".join([self.symbols[b] for b in w.encode("utf-8")])
            if w.isascii() and not w.isprintable():
                s = "".join([self.symbols[b] for b in w.encode("ascii")])
            spelled[s[:-1] + chr(ord(s[-1]) + END)] = w
        for s, last, _ in last_tokens(self.table, list(spelled)):
            tokens = path(self.table, last)
            self.kept_words[spelled[s]] = (b"".join([self.packed[t] for t in tokens]), b" ".join([self.shown[t] for t in tokens]))

    def encode(self, batch: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text: its ids as little-endian 32-bit integers, and the decoded text in UTF-8."""
        if len(self.kept) > KEPT_CHUNKS:
            self.kept.clear()
        get, split = self.kept.get, [self._chunks(t) for t in batch]
        found = [list(map(get, chunks)) for chunks in split]
        missed = [k for k, f in enumerate(found) if None in f]
        if missed:
            self._learn({c for k in missed for c, f in zip(split[k], found[k], strict=True) if f is None})
        for k in missed:
            found[k] = list(map(get, split[k]))
        for f in found:
            yield b"".join([ids for ids, _ in f]), b" ".join([d for _, d in f if d])


_codecs: dict[str, WordCodec] = {}


def codec(file: str) -> WordCodec:
    if file not in _codecs:
        _codecs[file] = WordCodec(file)
    return _codecs[file]


def _digest(file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()) for ids, text in codec(file).encode(batch.column("text").to_pylist())]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row of `docs`, other columns left out.

    A null or empty text, or one of white space, has 0 tokens and the digests of nothing. No shuffle.
    """
    return texts(docs).mapInArrow(_digest(file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, ids and decoded, the whole of both, under the same rules as `encode_digests`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = list(codec(file).encode(batch.column("text").to_pylist()))
            ids = pa.array([np.frombuffer(i, "<u4").astype("int32") for i, _ in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([d.decode() for _, d in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")

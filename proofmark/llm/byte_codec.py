"""Token ids of a byte-level BPE vocabulary, by chunks between spaces that a worker keeps."""

import json
import re

import tiktoken
from tokenizers import Tokenizer

from .common import release
from .word_codec import byte_symbols

#: Distinct chunks that a task keeps; a full store is emptied, which costs time and no result. Each takes about 200 bytes.
KEPT_CHUNKS = 500_000


class ByteCodec:
    """What the tokenizers library gives for the file, without added tokens; ids as little-endian 32-bit integers.

    No token reaches over a lone space, so chunks between lone spaces are encoded apart, by the same merges in another
    library. Texts with runs of white space go whole, those with rarer letters (U+0250 on) to the tokenizers library.
    """

    def __init__(self, file: str, pattern: str) -> None:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or (pre["type"], pre["add_prefix_space"], pre["use_regex"]) != ("ByteLevel", False, True) or spec["model"]["end_of_word_suffix"]:
            raise ValueError("not a byte-level BPE tokenizer of the kind this codec follows")
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.core = tiktoken.Encoding("byte", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rare = re.compile("[^\x00-ɏ -⁯]").search
        self.kept: dict[str, bytes | None] = {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _learn(self, chunk: str) -> bytes | None:
        """None: the text has to be encoded whole."""
        edge = chunk[1:2].isspace() or chunk[-1:].isspace() or chunk in ("", " ")
        ids = None if edge or self.rare(chunk) else self._pack(self.core.encode_ordinary(chunk))
        self.kept[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        if len(self.kept) > KEPT_CHUNKS:
            self.kept.clear()
        get = self.kept.get
        words = [" " + w for w in rest]
        if first:
            words.insert(0, first)
        elif text:
            return self._slow(text)
        out = list(map(get, words))
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    ids = self._learn(words[k]) if words[k] not in self.kept else self.kept[words[k]]
                    if ids is None:
                        return self._slow(text)
                    out[k] = ids
        return b"".join(out)

    def _slow(self, text: str) -> bytes:
        return self._pack(self.whole.encode(text, add_special_tokens=False).ids if self.rare(text) else self.core.encode_ordinary(text))


_codecs: dict[tuple[str, str], ByteCodec] = {}


def codec(file: str, pattern: str) -> ByteCodec:
    if (file, pattern) not in _codecs:
        _codecs[file, pattern] = ByteCodec(file, pattern)
        release()  # reading the file takes twice what stays of it
    return _codecs[file, pattern]

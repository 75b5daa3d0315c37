"""Byte-pair encoding by last tokens.

In a byte-pair encoding the tokens before the last one are the encoding of what stands before it. So the encoding of a
prefix is fully told by its last token, and a sequence is an encoding when each two neighbours, joined, encode to
themselves. `BpeTable` answers that for pairs; `last_tokens` walks distinct words in sorted order, which is a trie's
depth-first order: the states of the prefix that a word shares with the one before it are kept, not computed again.
"""

from collections.abc import Iterable, Iterator

UNKNOWN = -1


class BpeTable:
    """Tokens numbered by priority: base symbols first, then what each merge makes, from the first to the last.

    `merges` lists (left, right) strings, those with the same result in any order. `late` holds merged tokens that share
    one, the lowest, priority, where the leftmost pair wins.
    """

    def __init__(self, base: Iterable[str], merges: list[tuple[str, str]], late: Iterable[str] = ()) -> None:
        made = [a + b for a, b in merges]
        self.token = list(dict.fromkeys([*base, *made]))
        self.number = {t: i for i, t in enumerate(self.token)}
        self.n_base = len(self.token) - len(set(made))
        self.late = set(late)
        self.pair = {(self.number[a], self.number[b]): self.number[a + b] for a, b in merges if a in self.number and b in self.number}
        self.split = [(i, i) for i in range(len(self.token))]
        self._settle()
        self.ending = {t[k:]: UNKNOWN for t in self.number for k in range(len(t))} | self.number
        self.known: dict[int, bool] = {}
        self.shift = len(self.token).bit_length()

    def _settle(self) -> None:
        """The last merge that makes each token; tokens that their own text does not encode to can't occur."""
        for i in range(self.n_base, len(self.token)):
            parts = self.merge([self.number[c] for c in self._symbols(self.token[i])], stop=i)
            if len(parts) == 2 and self.pair.get((parts[0], parts[1])) == i:
                self.split[i] = (parts[0], parts[1])
            else:
                self.number.pop(self.token[i], None)

    def _symbols(self, text: str) -> Iterable[str]:
        return text

    def rank(self, token: int) -> int:
        return len(self.token) if self.late and self.token[token] in self.late else token

    def merge(self, parts: list[int], stop: int = -1) -> list[int]:
        """Plain byte-pair merging; ends before a merge that would give the single token `stop`."""
        parts = list(parts)
        while len(parts) > 1:
            best = min(((self.rank(m), k, m) for k in range(len(parts) - 1) if (m := self.pair.get((parts[k], parts[k + 1]))) is not None), default=None)
            if best is None or len(parts) == 2 and best[2] == stop:
                break
            parts[best[1] : best[1] + 2] = [best[2]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, joined, encode to these two."""
        key = left << self.shift | right
        if (known := self.known.get(key)) is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            if self.late and (self._late(left) or self._late(right)):
                text = self.token[left] + self.token[right]
                known = self.merge([self.number[c] for c in self._symbols(text)]) == [left, right]
            else:
                known = self._fits(left, right)
            self.known[key] = known
        return known

    def _late(self, token: int) -> bool:
        return self.token[token] in self.late

    def _fits(self, left: int, right: int) -> bool:
        """Undo the merges of both sides, latest first; a merge across the border that comes before what is undone would have happened."""
        pair, split, limit = self.pair, self.split, 1 << 60
        while True:
            across = pair.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit = left
                left = split[left][1]
                if left == limit:
                    limit = right + 1
                    right = split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = split[right][0]
                if right + 1 == limit:
                    limit = left
                    left = split[left][1]
                    if left == limit:
                        return True


def last_tokens(table: BpeTable, words: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
    """For each of the distinct words, in sorted order: the word, and by prefix length the last token and the token count.

    A symbol outside the table is UNKNOWN, one token. The two lists are reused: read them before the next word.
    """
    ending, fits, known, shift = table.ending, table.fits, table.known, table.shift
    last, count, before = [UNKNOWN], [0], ""
    for word in sorted(words):
        depth, most = 0, min(len(word), len(before))
        while depth < most and word[depth] == before[depth]:
            depth += 1
        del last[depth + 1 :], count[depth + 1 :]
        for end in range(depth + 1, len(word) + 1):
            for start in range(end - 1, -1, -1):
                token = ending.get(word[start:end])
                if token is None:
                    token = UNKNOWN
                    break
                if token < 0:
                    continue
                left = last[start]
                if start and left >= 0:
                    ok = known.get(left << shift | token)
                    if ok is None:
                        ok = fits(left, token)
                    if not ok:
                        continue
                break
            else:
                token = UNKNOWN
            last.append(token)
            count.append(count[start if token >= 0 else end - 1] + 1)
        before = word
        yield word, last, count


def path(table: BpeTable, last: list[int]) -> list[int]:
    """The tokens that the last tokens of the prefixes lead back to."""
    out, end = [], len(last) - 1
    while end > 0:
        token = last[end]
        out.append(token)
        end -= len(table.token[token]) if token >= 0 else 1
    return out[::-1]

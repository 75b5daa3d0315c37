"""Near copies by SimHash fingerprints and a hierarchical index in Gray order.

Fingerprints that differ in at most `bits` bits agree on one of `bits` + 1 blocks of bits, so each goes to one group for
each block; the blocks are as narrow as they can be for groups that one task can hold, so nearly all the search is the
index's. Within a group the fingerprints, sorted by Gray rank, make a tree: an upper node holds the bits that all below it
share and that no node above it holds; a search adds up differences on the way down and drops a whole node once there are
too many. Groups give a star of links, not all pairs, and the components of all stars are the groups of near copies.
"""

import hashlib
from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MARK, marks, sliced, stored, texts, tidy, with_mark
from .components import components

BITS = 64
#: Distinct fingerprints that a group, with an index of its own, is to have about, and those above which it is split by
#: further bits.
GROUP, SPLIT_ABOVE = 4096, 20_000
#: Children of an index node.
FAN = 4
#: Rows of groups that a task gets about: little to move, much to search.
ROWS_A_TASK = 32_768


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype=np.uint64, count=max(1, len(words) - size + 1))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int) -> int:
    """Bit i is 1 if it is 1 in over half the XXH64 hashes of the text's word shingles."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six ASCII spaces
    return _majority(_hashes(w, words)) if w else 0


def _fingerprints(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], names=["doc_id", "fp"])

    return tidy(run)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) for each row; a text without words, or null, has 0."""
    return texts(docs).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _blocks(free: list[int], n: int) -> list[int]:
    """`n` masks that deal out the bit numbers `free` in runs."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(free, n)] if free else []


def first_masks(bits: int, n: int, group: int = GROUP) -> list[int]:
    """Masks such that two fingerprints with at most `bits` differing bits agree on one of them.

    There are `bits` + 1 blocks, so one has no differing bit. They are as wide as it takes for groups of about `group` of
    `n` fingerprints; few fingerprints are one group, whose mask has no bit. The width tells the work, not the result.
    """
    step = BITS // (bits + 1)
    width = min(step, max(0, ceil(log2(max(1, n) / group))))
    return sorted({_signed((1 << width) - 1 << step * k) for k in range(bits + 1)})


def finer_masks(mask: int, bits: int) -> list[int]:
    """The same within the bits that `mask` leaves free, of which there are more than `bits` in a group to be split."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [_signed((mask & (1 << BITS) - 1) | int(b)) for b in _blocks(free, bits + 1)] if len(free) > bits else []


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.astype(np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class GrayIndex:
    """A tree over fingerprints in Gray order; each node keeps the shared bits that its parent does not."""

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        shared, pattern = np.full(len(codes), ~np.uint64(0)), self.codes
        levels = [(pattern, shared)]
        while len(pattern) > 1:
            starts = np.arange(0, len(pattern), FAN)
            ones, zeros = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            mask = np.bitwise_and.reduceat(shared, starts) & ~(ones ^ zeros)
            levels.append((ones & mask, mask))
            pattern, shared = levels[-1]
        self.levels = [(p, m & ~np.repeat(levels[k + 1][1], FAN)[: len(m)] if k + 1 < len(levels) else m) for k, (p, m) in enumerate(levels)]
        self.compared = 0  # nodes that searches have looked at, fingerprints included

    def search(self, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of a query, of a code in `codes`) that differ in at most `bits` bits."""
        pattern, mask = self.levels[-1]
        q, node = np.arange(len(queries)).repeat(len(pattern)), np.tile(np.arange(len(pattern)), len(queries))
        apart = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node]).astype(np.int16)
        self.compared += len(q)
        for pattern, mask in self.levels[-2::-1]:
            near = apart <= bits
            q, node, apart = q[near], node[near], apart[near]
            q, apart = q.repeat(FAN), apart.repeat(FAN)
            node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            inside = node < len(pattern)
            q, node, apart = q[inside], node[inside], apart[inside]
            apart = apart + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            self.compared += len(q)
        near = apart <= bits
        return q[near], node[near]


def _stars(codes: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For the fingerprints of one group: the ids of each that is linked and of the one that stands for all it is linked to."""
    index = GrayIndex(codes)
    codes, ids = index.codes, ids[index.order]
    root = np.arange(len(codes))

    def find(x: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := root[x], x):
            x = up
        return x

    step = max(1, 2_000_000 // len(codes))
    for at in range(0, len(codes), step):
        q, x = index.search(codes[at : at + step], bits)
        pairs = np.unique(np.stack([find(q + at), find(x)], 1), axis=0)
        for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            a, b = int(find(np.array([a]))[0]), int(find(np.array([b]))[0])
            root[max(a, b)] = min(a, b)
    root = find(root)
    linked = root != np.arange(len(codes))
    return ids[linked], ids[root[linked]]


def _links(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by mask and key; those of one mask and key are a group, searched by an index of its own."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []  # of the group at the end of the last batch
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp = (batch.column(c).to_numpy() for c in ("mask", "key", "fp"))
            starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(fp)], strict=True):
                if held and held_key != (mask[a], key[a]):
                    yield np.concatenate(held)
                    held = []
                held.append(fp[a:b])
                held_key = mask[a], key[a]
        if held:
            yield np.concatenate(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in groups(batches):
            if len(fp) > 1:
                a, b = _stars(fp.view(np.uint64), fp, bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return tidy(run)


def links(fps: DataFrame, bits: int = 3, split_above: int = SPLIT_ABOVE, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between the distinct longs of column fp: their components are those of "differs in at most `bits` bits".

    No link is lost. A group of more than `split_above` fingerprints is split by `bits` + 1 blocks of the bits it does not
    share, as often as that takes; nothing is left out.
    """
    n = fps.count()
    split_above = max(split_above, 2 << bits)  # so that a group to be split has more than `bits` free bits
    masks = first_masks(bits, n, group)
    rows = n * len(masks)
    level = fps.select("fp", F.explode(F.array(*map(_long, masks))).alias("mask"))
    out = []
    while True:
        level = level.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        large = level.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > split_above)
        large = stored(large, "large")
        split = {r["mask"]: r["n"] for r in large.groupBy("mask").agg(F.sum("n").alias("n")).collect()}  # out of the masks of this round
        if not split:
            out.append(level)
            break
        finer = {m: finer_masks(m, bits) for m in split}
        out.append(level.join(large, ["mask", "key"], "left_anti"))
        to = F.create_map(*(x for m, f in finer.items() for x in (_long(m), F.array(*map(_long, f)))))
        level = level.join(large, ["mask", "key"], "left_semi").select("fp", F.explode(to[F.col("mask")]).alias("mask"))
        masks = sorted({x for f in finer.values() for x in f})
        rows += sum(split.values()) * bits
    keyed = out[0]
    for more in out[1:]:
        keyed = keyed.unionByName(more)
    keyed = keyed.select("mask", "key", "fp").repartition(max(1, -(-rows // ROWS_A_TASK)), "mask", "key").sortWithinPartitions("mask", "key")
    return keyed.mapInArrow(_links(bits), "a long, b long")


def near_copies(fps: DataFrame, bits: int = 3, split_above: int = SPLIT_ABOVE, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links lead to, for rows of doc_id and fp.

    Equal fingerprints are one node of the graph, however many rows have them. Each join is of two written tables, so that
    Spark can split the rows of a frequent fingerprint or of a large cluster over many tasks.
    """
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(nodes.select("fp"), bits, split_above, group))
    linked = stored(nodes.join(roots, nodes.fp == roots.node).select("fp", "least", "root"), "linked")
    clusters = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "clusters")
    placed = stored(linked.join(clusters, "root").select("fp", "component_id"), "placed")
    named = stored(nodes.join(placed, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of `docs`; other columns are left out.

    Texts without words and null texts have fingerprint 0 and are linked like any other. A repeated row is a copy of
    itself. An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, words), "fps")
    return near_copies(fps, bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Texts are similar if they share this part of their sets of five-word shingles.
SIMILARITY, SHINGLE = 0.8, 5
#: Least hashes of a set, in bands: sets that share 0.8 agree on a band with 0.8^4, and miss all 32 with 5 in 10^8, whatever
#: was edited and however large the table is.
BANDS, BAND = 32, 4
#: Equal least hashes, of 128, below which a pair that shares a band is not compared exactly: 6.7 standard deviations
#: under what sets that share 0.8 have.
ALIKE = 72
#: Rows of either side that meet in one cell, see `_left_over`.
CELL = 500

_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BAND_OF = np.random.default_rng(6).integers(0, 1 << 63, (BANDS, BAND + 1), dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of the text's five-word shingles in ascending order; none of a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(_hashes(words, SHINGLE)) if words else np.zeros(0, np.uint64)


def set_name(hashes: np.ndarray) -> int:
    """A 64-bit name of the set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of the set under each of 128 further hashes."""
    least = np.full(BANDS * BAND, ~np.uint64(0))
    mixed = hashes ^ (hashes >> np.uint64(31))
    for at in range(0, len(mixed), 1024):
        made = mixed[at : at + 1024, None] * _FACTORS
        least = np.minimum(least, (made ^ (made >> np.uint64(32))).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band; keys of different bands differ."""
    x = (least.reshape(BANDS, BAND) * (_BAND_OF[:, :BAND] | np.uint64(1))).sum(axis=1, dtype=np.uint64) ^ _BAND_OF[:, BAND]
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        least = [least_hashes(s) for s in sets]
        columns = [
            batch.column("doc_id"),
            pa.array([set_name(s) for s in sets], pa.int64()),
            pa.array([len(s) for s in sets], pa.int32()),
            pa.array([(x & np.uint64(255)).astype(np.uint8).tobytes() for x in least], pa.binary()),
            pa.array([band_keys(x).view(np.int64) for x in least], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "size", "least", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "hashes"])


def _alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sets, in ascending order, share that part of their union."""
    if not len(p) or not len(q):
        return len(p) == len(q)
    at = np.searchsorted(p, q)
    at[at == len(p)] = 0
    shared = int((p[at] == q).sum())
    return shared / (len(p) + len(q) - shared) >= similarity


def _exact(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pairs = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            keep = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return tidy(run)


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of names whose sets share at least `similarity` of their shingles, exactly."""
    x, y = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_exact(similarity), "a long, b long")


def _settle(rows: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """Links of one cell: each left row is compared with the right rows of other components, the most alike first, and by
    exact count; what a link joins is not compared again. So there are fewer links than components, whatever the cell holds."""
    fp, root, size, left, least, hashes = zip(*rows, strict=True)
    roots, number = np.unique(np.array(root, np.int64), return_inverse=True)
    up = list(range(len(roots)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    left, size = np.array(left, bool), np.array(size, np.int64)
    least = np.frombuffer(b"".join(least), np.uint8).reshape(len(fp), -1)
    right = np.flatnonzero(~left)
    sets: dict[int, np.ndarray] = {}
    of = lambda k: sets.setdefault(k, np.frombuffer(hashes[k], np.uint64))
    out = []
    for k in np.flatnonzero(left).tolist():
        own = find(int(number[k]))
        near = np.minimum(size[right], size[k]) >= similarity * np.maximum(size[right], size[k]) - 1e-6
        at = right[near & (number[right] != number[k])]
        equal = (least[at] == least[k]).sum(axis=1)
        at = at[np.argsort(-equal, kind="stable")][: int((equal >= ALIKE).sum())]
        for x in at.tolist():
            other = find(int(number[x]))
            if other != own and _alike(of(k), of(x), similarity):
                out.append((fp[k], fp[x]))
                up[other] = own
    return out


def _cells(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by key and cell."""

    def links_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = _settle([r[3:] for r in rows], similarity)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in sliced(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "fp", "root", "size", "left", "least", "hashes")), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield from links_of(held)
                    held = []
                held.append(row)
        if held:
            yield from links_of(held)

    return tidy(run)


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, fp) of the groups that hold several components, with their root, whether that is outside the group's
    largest component, and the numbers of the group's rows (n) and of those outside (m)."""
    named = members.join(roots, members.fp == roots.node, "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "named")
    parts = named.groupBy("key", "root").agg(F.count("*").alias("rows"))
    groups = parts.groupBy("key").agg(F.max(F.struct("rows", "root")).alias("main"), F.sum("rows").alias("n"), F.count("*").alias("parts"))
    groups = groups.filter("parts > 1").select("key", "n", (F.col("n") - F.col("main.rows")).alias("m"), F.col("main.root").alias("main"))
    return stored(named.join(stored(groups, "groups"), "key").select("key", "fp", "root", "n", "m", (F.col("root") != F.col("main")).alias("outside")), "mixed")


#: Hashes that a task hands on at once.
HANDED = 1 << 20


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (fp, hash) for each hash of each set."""
    names: list[int] = []
    held: list[np.ndarray] = []

    def rows() -> pa.RecordBatch:
        repeated = np.repeat(np.array(names, np.int64), [len(h) for h in held])
        return pa.RecordBatch.from_arrays([pa.array(repeated), pa.array(np.concatenate(held).view(np.int64))], names=["fp", "hash"])

    size = 0
    for batch in sliced(batches):
        for fp, hashes in zip(batch.column("fp").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            names.append(fp)
            held.append(np.frombuffer(hashes, np.uint64))
            size += len(held[-1])
            if size >= HANDED:
                yield rows()
                names, held, size = [], [], 0
    if held:
        yield rows()


def _with_partners(large: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (key, fp) of large groups that may be similar to another, and links between these and one row of their group.

    `own` counts the hashes of a set that no other has. Two sets share at most what either has besides, so they share the
    part t of their union only if own + own' <= (1 - t) / t * (size - own). A row for which the least `own` of its group is
    too much has no partner there: texts of one template that differ in more than t allows go without being compared.
    The others are compared with that row, as a template's plainest copy is the one that most of them are similar to.
    """
    asked = sets.join(large.select("fp").distinct(), "fp", "left_semi")
    hashes = asked.mapInArrow(tidy(_spread), "fp long, hash long").groupBy("hash").agg(F.count("*").alias("sets"), F.min("fp").alias("fp"))
    own = stored(hashes.filter("sets = 1").groupBy("fp").agg(F.count("*").alias("own")), "own")
    rows = large.select("key", "fp", "root").join(nodes.select("fp", "size"), "fp").join(own, "fp", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    rows = stored(rows, "rows")
    least = stored(rows.groupBy("key").agg(F.min(F.struct("own", "fp", "root")).alias("least")), "least")
    room = (F.col("size") - F.col("own")) * (1 - similarity) / similarity + 1e-6
    kept = stored(rows.join(least, "key").filter(F.col("own") + F.col("least.own") <= room), "kept")
    pairs = stored(kept.filter("root <> least.root").select(F.col("least.fp").alias("a"), F.col("fp").alias("b")).distinct(), "pairs")
    return kept.select("key", "fp"), stored(similar_pairs(pairs, sets, similarity), "partners")


def _left_over(mixed: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, cell: int) -> DataFrame:
    """Links (a, b) between rows that share a band, are not in one component yet and are similar by exact count.

    Rows outside a group's main component are compared with all rows of the group: those on the left, all on the right,
    each side dealt into blocks of about `cell` rows. Rows of the main component are never compared with each other, so a
    large group of near copies goes to the cells once, not once for each block.
    """
    rows = mixed.join(nodes.select("fp", "size", "least"), "fp")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(cell)).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("fp"), blocks(n)).cast("int")
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    rights = F.transform(F.sequence(F.lit(0), blocks("m") - 1), lambda i: place(i, mine("n"), False))
    lefts = F.transform(F.sequence(F.lit(0), blocks("n") - 1), lambda j: place(mine("m"), j, True))
    cells = F.when(F.col("outside"), F.concat(rights, lefts)).otherwise(rights)
    dealt = rows.join(sets, "fp").select("key", F.explode_outer(cells).alias("c"), "fp", "root", "size", "least", "hashes")
    dealt = dealt.select("key", "c.i", "c.j", "c.left", "fp", "root", "size", "least", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_cells(similarity), "a long, b long")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of the group, for each row of `docs` with a doc_id.

    Two texts are linked if their sets of five-word shingles share `similarity`, by exact count. Compared are those that
    agree on a band of least hashes: first each with one of its group, then all that are not in one component by then. Of
    groups with over `cell` rows outside their main component, rows that can't have a partner are left out first.
    Equal sets are one node. Texts without words are one group.
    """
    rows = texts(docs).filter("doc_id is not null")
    fps = stored(rows.mapInArrow(tidy(_sketches), "doc_id long, fp long, size int, least binary, bands array<long>"), "sketches")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.first(F.struct("size", "least", "bands")).alias("s"))
    nodes = stored(first.select("fp", "id", "s.size", "s.least", "s.bands"), "nodes")
    keyed = nodes.select("fp", F.explode("bands").alias("key"))
    groups = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    members = stored(keyed.join(groups, "key"), "members")
    asked = stored(nodes.select("fp", "id").join(members.select("fp").distinct(), "fp", "left_semi"), "asked")
    wanted = with_mark(rows, marks(asked.select(F.col("id").alias("doc_id")))).filter(MARK).join(asked.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = wanted.select("text").mapInArrow(tidy(_sets), "fp long, hashes binary").join(asked.select("fp"), "fp", "left_semi")
    sets = stored(sets.dropDuplicates(["fp"]), "sets")
    stars = stored(members.filter("fp <> a").select("a", F.col("fp").alias("b")).distinct(), "stars")
    edges = stored(similar_pairs(stars, sets, similarity), "similar")
    roots = components(edges)
    mixed = _mixed(members, roots)
    large = mixed.filter(F.col("m") > cell)
    if not large.isEmpty():
        kept, partners = _with_partners(large, nodes, sets, similarity)
        edges = edges.unionByName(partners)
        roots = components(edges)
        mixed = _mixed(mixed.filter(F.col("m") <= cell).select("key", "fp").unionByName(kept), roots)
    more = stored(_left_over(mixed, nodes, sets, similarity, cell), "more")
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return fps.select("doc_id", "fp").join(named, "fp").select("doc_id", "component_id")


def merged_groups(*parts: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links of any part lead to, for each doc_id that has a link.

    Parts have doc_id and component_id, the smallest doc_id of a group, of rows that all have a doc_id.
    """
    links = parts[0].select("doc_id", "component_id")
    for more in parts[1:]:
        links = links.unionByName(more.select("doc_id", "component_id"))
    edges = stored(links.filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "group_links")
    roots = stored(components(edges), "group_roots")
    least = stored(roots.groupBy("root").agg(F.min("node").alias("component_id")), "group_names")
    return roots.join(least, "root").select(F.col("node").alias("doc_id"), "component_id")

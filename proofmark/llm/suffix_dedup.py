"""Removal of byte strings that start at more than one place, by prefix doubling over a sample of positions.

A string's name (a 64-bit rank that equal strings share) is made of the names of its halves, at offsets 1, 2, 4, ... 64
and at last 72, which gives strings of 200 bytes. Sorting every position of the corpus at every offset would move
hundreds of bytes for each byte of text, so Spark sorts a sample that loses nothing:

1. Each string of 200 bytes belongs to the least-named string of 64 bytes inside it, its anchor. The places of
   neighbouring strings with one anchor are a run. Equal strings have equal anchors at equal distance.
2. Runs are sorted by (name of the anchor, name of the whole run). An anchor that occurs once is unique: its strings are
   settled as not repeated. Equal whole runs are settled as repeated. Others, mostly at the borders of what repeats, go on.
3. The text of those runs meets by anchor, and their strings of 200 bytes are ranked one by one. Where an anchor has many
   different runs, Spark makes the last step of the doubling itself: it counts the pairs of names at each place and 72
   bytes on, so that the strings of a frequent passage spread over all tasks.
4. The repeated places of a document cut its bytes.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MARK, marks, sliced, stored, texts, tidy, with_mark

SPAN = 200
ANCHOR = 64
WINDOW = SPAN - ANCHOR + 1
LAST_OFFSET = SPAN - 2 * ANCHOR
#: Bytes of text that are named at once.
BLOCK = 1 << 18
#: Different runs of one anchor above which their strings are counted in Spark.
SPLIT_ABOVE = 1000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x += b * _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64), np.arange(256, dtype=np.uint64)[::-1].copy())


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the strings of 64 and of 128 bytes at each place of `data` that has as many bytes."""
    name, length = _BYTE[data], 1
    while length < ANCHOR:
        name = _mix(name[:-length], name[length:])
        length *= 2
    return name, _mix(name[:-ANCHOR], name[ANCHOR:])


def span_names(half: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The names of the strings of 200 bytes at `at`: halves of 128 bytes that overlap."""
    return _mix(half[at], half[at + LAST_OFFSET])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(x.dtype).max, dtype=x.dtype)
    rows = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the concatenated texts that end at `ends`: each run's text, first and last place, and its two names."""
    starts = np.concatenate([[0], ends[:-1]])
    if len(data) < SPAN:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    name, half = names(data)
    bits = np.uint64(max(20, int(len(data)).bit_length()))
    place = np.arange(len(name), dtype=np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = _window_min((name & ~low) | place, WINDOW)
    whole = np.zeros(len(least) + 1, dtype=np.int8)
    for a, b in zip(starts, ends - SPAN + 1, strict=True):  # places where 200 bytes of one text are left
        if b > a:
            whole[a] += 1
            whole[b] -= 1
    at = np.flatnonzero(np.cumsum(whole[:-1]))
    if not len(at):
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    anchor = (least[at] & low).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    anchor = anchor[new]
    text = np.searchsorted(ends, first, side="right")
    shape = ((last - first) << 8 | (anchor - first)).astype(np.uint64)
    return text, first - starts[text], last - starts[text], name[anchor], _mix(_mix(span_names(half, first), span_names(half, last)), shape)


def _tag(text: bytes) -> int:
    """Tells texts apart that share a key."""
    return hashlib.blake2b(text, digest_size=2).digest()[0] << 7 | hashlib.blake2b(text, digest_size=2).digest()[1] >> 1


def _place(first: np.ndarray, last: np.ndarray, tag: np.ndarray, twin: np.ndarray) -> np.ndarray:
    """One long: first place, tag (15 bits), places less one (8 bits), whether a twin is known (1 bit)."""
    return (first << 24) | (tag << 9) | ((last - first) << 1) | twin


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place, and the tag."""
    first = place >> 24
    return first, first + (place >> 1 & 0xFF), place >> 9 & 0x7FFF


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, bodies, size = [], [], 0
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        body = text.encode("utf-8", "surrogatepass")
        ids.append(doc)
        bodies.append(body)
        size += len(body)
        if size >= BLOCK:
            yield ids, bodies
            ids, bodies, size = [], [], 0
    if ids:
        yield ids, bodies


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, whole, doc_id, place). Runs that are equal within a batch are settled here; all but one of them get an
    anchor of their own, so that a frequent run does not gather in one task."""
    for batch in batches:
        parts: list[tuple[np.ndarray, ...]] = []
        for ids, bodies in _blocks(batch):
            data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
            text, first, last, anchor, whole = runs(data, np.cumsum([len(b) for b in bodies]))
            tag = np.array([_tag(b) if len(b) >= SPAN else 0 for b in bodies], dtype=np.int64)
            parts.append((anchor, whole, np.array(ids, dtype=np.int64)[text], first, last, tag[text]))
        anchor, whole, doc, first, last, tag = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6
        order = np.lexsort((whole, anchor))
        a, w = anchor[order], whole[order]
        same = (a[1:] == a[:-1]) & (w[1:] == w[:-1])
        twin, later = np.zeros(len(a), bool), np.zeros(len(a), bool)
        twin[1:] |= same
        twin[:-1] |= same
        later[1:] = same
        place = _place(first[order], last[order], tag[order], twin.astype(np.int64))
        a = np.where(later, _mix(doc[order].astype(np.uint64), place.astype(np.uint64)), a)
        w = np.where(later, a, w)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(w.view(np.int64)), pa.array(doc[order]), pa.array(place)], names=["anchor", "whole", "doc_id", "place"])


REPEATED, PARTNER, OPEN = 0, 1, 2


def _ranked(docs: DataFrame) -> DataFrame:
    """Runs that are repeated (0), stand for others when they are repeated (1), or are open (2); split: by more than the anchor."""
    rows = docs.mapInArrow(tidy(_sampled), "anchor long, whole long, doc_id long, place long")
    rows = rows.repartition("anchor").sortWithinPartitions("anchor", "whole", "doc_id", "place")
    one, all_ = W.partitionBy("anchor", "whole"), W.partitionBy("anchor")
    several = (F.max("twin").over(one) == 1) | (F.count("*").over(one) > 1)
    rows = rows.withColumn("twin", F.col("place").bitwiseAND(F.lit(1)))
    rows = rows.withColumns({"nth": F.row_number().over(one.orderBy("doc_id", "place")), "several": several})
    rows = rows.withColumn("kinds", F.sum((F.col("nth") == 1).cast("long")).over(all_))
    mixed = F.col("kinds") > 1
    state = F.when(F.col("several"), F.when(mixed & (F.col("nth") == 1), PARTNER).otherwise(REPEATED)).when(mixed, OPEN)
    return rows.select("anchor", "doc_id", "place", state.alias("state"), (F.col("kinds") > SPLIT_ABOVE).alias("split")).filter("state is not null")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, dict, int, int]]:
    """Each asked run with its document, the document's tag and bytes, and its first and last place."""
    for batch in sliced(batches):
        for doc, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            body = text.encode("utf-8", "surrogatepass")
            tag = _tag(body) if len(body) >= SPAN else 0
            place = np.array([r["place"] for r in asked], dtype=np.int64)
            for r, first, last, t in zip(asked, *(x.tolist() for x in _unplace(place)), strict=True):
                if t == tag and last + SPAN <= len(body):
                    yield doc, tag, body, r, first, last


def _table(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


#: Rows that a task hands on at once.
HANDED = 20_000


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each asked run."""
    types = {"anchor": pa.int64(), "doc_id": pa.int64(), "place": pa.int64(), "state": pa.int32(), "body": pa.binary()}
    rows = []
    for doc, _, body, r, first, last in _asked(batches):
        rows.append((r["anchor"], doc, r["place"], r["state"], body[first : last + SPAN]))
        if len(rows) == HANDED:
            yield _table(rows, **types)
            rows = []
    yield _table(rows, **types)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of 200 bytes of the asked runs as the pair of names at its start and 72 bytes on, 128 bits together."""
    columns = ["one", "two", "doc_id", "place", "open"]
    parts: list[tuple[np.ndarray, ...]] = []
    for doc, tag, body, r, first, last in _asked(batches):
        _, half = names(np.frombuffer(body, dtype=np.uint8)[first : last + SPAN])
        at = np.arange(last - first + 1)
        place = _place(first + at, first + at, np.int64(tag), np.int64(0))
        parts.append((half[at].view(np.int64), half[at + LAST_OFFSET].view(np.int64), np.full(len(at), doc, np.int64), place, np.full(len(at), r["state"] == OPEN)))
        if len(parts) * WINDOW >= HANDED:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=columns)
            parts = []
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=columns)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor: the places of open runs whose 200 bytes occur in another run of the anchor."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "place", "state", "body")), strict=True)
        cut = len(held)
        while cut and held[cut - 1][0] == held[-1][0]:
            cut -= 1
        if cut:
            yield _repeats(held[:cut])
            held = held[cut:]
    if held:
        yield _repeats(held)


def _repeats(rows: list[tuple]) -> pa.RecordBatch:
    found_doc, found_place = [], []
    place = np.array([r[2] for r in rows], dtype=np.int64)
    first, last, tag = _unplace(place)
    data = np.frombuffer(b"".join([r[4] for r in rows]), dtype=np.uint8)
    ends = np.cumsum([len(r[4]) for r in rows])
    n = last - first + 1
    starts = ends - (n + SPAN - 1)
    row = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    _, half = names(data)
    name = span_names(half, starts[row] + step)
    anchor = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    key = _mix(name, anchor[row])
    order = np.argsort(key, kind="stable")
    k, m, a = key[order], name[order], anchor[row][order]
    same = (k[1:] == k[:-1]) & (m[1:] == m[:-1]) & (a[1:] == a[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    repeated = np.zeros(len(k), bool)
    repeated[order] = twice
    is_open = np.array([r[3] == OPEN for r in rows])
    hit = np.flatnonzero(repeated & is_open[row])
    if len(hit):
        new = np.concatenate([[True], (row[hit][1:] != row[hit][:-1]) | (step[hit][1:] != step[hit][:-1] + 1)])
        a = hit[new]
        b = hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hit) - 1]])]
        found_place = _place(first[row[a]] + step[a], first[row[b]] + step[b], tag[row[a]], np.zeros(len(a), np.int64))
        found_doc = np.array([r[1] for r in rows], dtype=np.int64)[row[a]]
    return pa.RecordBatch.from_arrays([pa.array(found_doc, pa.int64()), pa.array(found_place, pa.int64())], names=["doc_id", "place"])


def merged(place: list[int] | None, body: bytes) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the places' strings cover."""
    if not place:
        return []
    first, last, tag = _unplace(np.array(place, dtype=np.int64))
    mine = (tag == _tag(body)) & (last + SPAN <= len(body)) if len(body) >= SPAN else np.zeros(len(first), bool)
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first[mine].tolist(), (last[mine] + SPAN).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _key() -> Column:
    """A row's doc_id and text as one number, so that rows that share a doc_id, or have none, are apart; rows that repeat each
    other share theirs, and their places."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _with_text(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts of the asked runs, each with its runs."""
    wanted = with_mark(rows, marks(asked)).filter(MARK).select("doc_id", "text")
    runs_ = asked.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "place", "state")).alias("asked"))
    return wanted.join(runs_, "doc_id")


def repeated_places(rows: DataFrame) -> DataFrame:
    """doc_id and place for every repeated string of the texts, rows (doc_id, text) without nulls; see `merged`."""
    ranked = stored(_ranked(rows), "ranked")
    asked = ranked.filter(F.col("state") >= PARTNER)
    few, many = asked.filter(~F.col("split")), asked.filter("split")
    contexts = _with_text(rows, few).mapInArrow(tidy(_contexts), "anchor long, doc_id long, place long, state int, body binary")
    contexts = contexts.repartition("anchor").sortWithinPartitions("anchor")
    found = ranked.filter(F.col("state") <= PARTNER).select("doc_id", "place").unionByName(contexts.mapInArrow(tidy(_compared), "doc_id long, place long"))
    if not many.isEmpty():
        strings = _with_text(rows, many).mapInArrow(tidy(_strings), "one long, two long, doc_id long, place long, open boolean")
        strings = stored(strings, "strings")
        twice = stored(strings.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").select("one", "two"), "twice")
        found = found.unionByName(strings.filter("open").join(twice, ["one", "two"]).select("doc_id", "place"))  # written tables: Spark splits a frequent string
    plain = F.col("place").bitwiseAND(F.lit(-2)).alias("place")  # without the bit of a twin, so that copies of a place are equal
    return stored(found.select("doc_id", plain), "repeated")


def _cut(finish: Callable[[bytes, list[tuple[int, int]]], tuple], names_: list[str], types: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                body = text.encode("utf-8", "surrogatepass")
                out.append(finish(body, merged(places, body)))
            columns = list(zip(*out, strict=True)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names_])

    return tidy(run)


def _kept(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(body[at:a])
        at = b
    return b"".join([*out, body[at:]])


def _digests(body: bytes, spans: list[tuple[int, int]]) -> tuple:
    return len(body), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(body, spans)).hexdigest()


def _whole_characters(body: bytes, spans: list[tuple[int, int]]) -> str:
    """The kept text; a character of which a byte stays, stays whole."""
    inner = []
    for a, b in spans:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        inner.append((a, b))
    return _kept(body, inner).decode("utf-8", "surrogatepass")


def _split_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose text can't have repeats, and (doc_id, text, places) of the others. Only the others' text is moved."""
    rows = texts(docs).select(_key().alias("doc_id"), F.col("doc_id").alias("id"), "text")
    places = repeated_places(rows.select("doc_id", "text"))
    marked = with_mark(rows, marks(places))
    grouped = places.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    touched = marked.filter(MARK).drop(MARK).join(grouped, "doc_id", "left").select(F.col("id").alias("doc_id"), "text", "places")
    return marked.filter(~F.col(MARK)).select(F.col("id").alias("doc_id"), "text"), touched


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of `docs`.

    Every byte goes that a string of 200 bytes covers which also starts anywhere else, in this text or another. A null or
    empty text has no bytes and the digest of nothing; texts under 200 bytes stay whole; of rows that repeat each other
    all strings of 200 bytes repeat. A doc_id may be missing or repeated. Other columns are left out.
    """
    clean, touched = _split_rows(docs)
    names_ = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    cut = touched.mapInArrow(_cut(_digests, names_, [pa.int64(), pa.int64(), pa.int64(), pa.string()]), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    plain = clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
    return plain.unionByName(cut)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with its own columns, the text without its repeated strings and n_chars, where there is one, as it is then.

    A character of which a byte stays, stays whole. A null text stays null; a text of repeats alone is empty. Rows stay.
    """
    keyed = texts(docs).select(_key().alias("doc_id"), "text")
    places = repeated_places(keyed)
    rows = docs.select(F.struct("*").alias("row"), "text", _key().alias("doc_id"))
    marked = with_mark(rows, marks(places))
    grouped = places.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    touched = marked.filter(MARK).join(grouped, "doc_id", "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(text, places, strict=True):
            body = None if t is None else t.encode("utf-8", "surrogatepass")
            out.append(t if t is None or p is None else _whole_characters(body, merged(list(p), body)))
        return pd.Series(out, dtype=object)

    touched = touched.select("row", cut("text", "places").alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    done = touched.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
    return marked.filter(~F.col(MARK)).select("row.*").unionByName(done)

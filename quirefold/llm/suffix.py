"""Suffix-array dedup of long repeated byte strings, by column-wise construction over many short strings.

Documents are cut into spans around anchors (see spans): every window of `size` bytes lies in one span and equal
windows lie at equal offsets of spans with the same anchor. Spans whose content occurs twice are repeated as a whole.
Anchors found with different contents form collections of strings, aligned at the anchor. For each collection the
order of all suffixes is built column by column from the right end: each round inserts one symbol of every string,
sorts the strings stably by it, and updates the common prefixes of neighbours. Since equal windows start in the same
column, each column keeps its own segment of the collection's transform. A window is repeated where a suffix shares at
least `size` bytes with a neighbour.

Every collection holds at most COLLECTION strings. An anchor with more is split by its strings' next symbols: its windows
are cut into classes of CLASS neighbouring offsets, all windows of a class hold the same stretch of bytes around the
anchor, and what that stretch reads decides the collection. A stretch that still has too many different surroundings
is cut once more, into single windows, where the stretch is the window and a collection needs no order, only its number
of members. So whatever is compared fits a task, nothing is left out, and every level does the same to its strings.

Memory: a round needs only the previous round's order and common prefixes; transforms() writes the columns one after
another as rows of sequential files.

Null and short texts: nothing removed. Null doc_id: counts as the smallest id. Rows with the same id and the same text
are still two documents: a long text that occurs twice is removed from both. Very long texts: whole, cut into spans.
Ties don't occur: all copies of a window go, the first included. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleared, release, stored
from .spans import Bytes, keyed, merged, span_rows, with_requests

WINDOW = 400
GRAM = 32
#: Strings in one collection, at most.
COLLECTION = 4096
#: Neighbouring offsets from the anchor in one class of windows.
CLASS = 46
PAD = 256


def column_order(strings: np.ndarray, sink: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column from the right: its number, the strings ordered by their suffixes from it, common prefixes.

    strings: a matrix of symbols, one row a string. prefixes[k]: of the k-th and the one before it. sink gets, for each
    column, the transform's symbols (what precedes each suffix), the order and the prefixes.
    """
    m, width = strings.shape
    order, prefixes = np.arange(m), np.zeros(m + 1, np.int32)
    for column in range(width - 1, -1, -1):
        symbols = strings[order, column]
        turn = np.argsort(symbols, kind="stable")
        low, high = turn[:-1] + 1, turn[1:] + 1
        equal = symbols[turn[1:]] == symbols[turn[:-1]]
        new = np.zeros(m + 1, np.int32)
        if m > 1:
            near = equal & (high - low == 1)
            new[1:m][near] = prefixes[low[near]] + 1
            far = np.flatnonzero(equal & ~near)
            if len(far):
                pairs = np.column_stack([low[far], high[far]]).ravel()
                new[1:m][far] = np.minimum.reduceat(prefixes, pairs)[::2] + 1
        order, prefixes = order[turn], new
        if sink:
            sink(column, strings[order, column - 1] if column else np.full(m, PAD, strings.dtype), order, prefixes)
        yield column, order, prefixes


def aligned(strings: list[bytes], offsets: list[int]) -> np.ndarray:
    grid = np.full((len(strings), max(o + len(s) for s, o in zip(strings, offsets, strict=True))), PAD, np.uint16)
    for row, s, o in zip(grid, strings, offsets, strict=True):
        row[o : o + len(s)] = np.frombuffer(s, np.uint8)
    return grid


def repeated_windows(strings: list[bytes], offsets: list[int], counts: list[int], size: int) -> list[np.ndarray]:
    """For each string, which of its `counts` first windows also occur in another string at the same aligned column."""
    grid = aligned(strings, offsets)
    hits = np.zeros((len(strings), grid.shape[1] + 1), bool)
    first, last = min(offsets), max(o + n for o, n in zip(offsets, counts, strict=True))
    for column, order, prefixes in column_order(grid):
        if column < first:
            break
        if column < last:
            long = prefixes >= size
            hits[order, column] = long[:-1] | long[1:]
    return [hits[k, o : o + n] for k, (o, n) in enumerate(zip(offsets, counts, strict=True))]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """start and length of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(s), int(e - s)) for s, e in zip(edges[::2], edges[1::2], strict=True)]


STRING_SCHEMA = "a long, did long, th long, lo int, n int, p int, many int, content binary, c long"


def _cut(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        rows: list[tuple] = []

        def emitted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in STRING_SCHEMA.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for did, th, text, asked in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "text", "asked")), strict=True):
                raw = text.encode()
                rows += [(x["a"], did, th, x["lo"], x["n"], x["p"], x["many"], raw[x["lo"] : x["lo"] + x["n"] + size - 1], x["c"]) for x in asked]
                if len(rows) > 10_000:
                    yield emitted()
        if rows:
            yield emitted()

    return scan


#: Strings in this order have those of rows equal in id and text beside each other.
STRING_ORDER = ["a", "did", "th", "lo"]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Strings in STRING_ORDER, as collections: whole groups of one anchor, together at most COLLECTION or one group."""
    part: list[tuple] = []
    group: list[tuple] = []
    before = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
            same, before = row[:4] == before, row[:4]
            if same:
                continue
            if group and row[0] != group[0][0]:
                if part and len(part) + len(group) > COLLECTION:
                    yield part
                    part = []
                part, group = part + group, []
            group.append(row)
    yield from (x for x in ([part, group] if len(part) + len(group) > COLLECTION else [part + group]) if x)


def _collections(size: int):
    """Strings sorted by anchor -> did, th, lo, n of repeated windows. Holds one collection at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches):
            lead = max(p - lo for _, _, _, lo, _, p, _, _ in part)
            found = repeated_windows([r[7] for r in part], [lead - (r[5] - r[3]) for r in part], [r[4] for r in part], size)
            rows = [(r[1], r[2], r[3] + s, k) for r, flags in zip(part, found, strict=True) if not r[6] for s, k in runs(flags)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["did", "th", "lo", "n"])

    return scan


PART_SCHEMA = "a long, s long, did long, th long, lo int, n int, p int, kind int, content binary"


def _divided(size: int, wide: int):
    """Strings -> spans of at most `wide` neighbouring offsets from the anchor, under the hash of what all of these share."""
    names, kinds = [x.split()[0] for x in PART_SCHEMA.split(", ")], [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()]
    number = lambda *parts: int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for a, did, th, lo, n, p, many, content in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                raw, at = memoryview(content), p - lo  # the anchor's place in the content
                anchor = a.to_bytes(8, "little", signed=True)
                for k in range((at - n + 1) // wide, at // wide + 1):
                    low, high = max(at - n + 1, k * wide), min(at, (k + 1) * wide - 1)
                    # every window of class k starts at or before at - k * wide and ends at or after at + size - (k + 1) * wide + 1
                    core = raw[at - k * wide : at + size - (k + 1) * wide + 1]
                    part = raw[at - high : at - low + size]
                    rows.append((number(anchor, k.to_bytes(4, "little"), core), number(low.to_bytes(4, "little"), part), did, th, p - high, high - low + 1, p, many, bytes(part) if wide > 1 else b""))
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return scan


def _settled(spans: DataFrame, name: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Ranges of spans whose content occurs twice; and the first span of each content (a, did, th, lo, n, p, *more, many, c) where an anchor has c > 1."""
    contents = stored(
        spans.groupBy("a", "s").agg(F.min(F.struct("did", "th", "lo", "n", "p", *more)).alias("first"), F.when((F.count("*") > 1) | (F.max("kind") > 0), 1).otherwise(0).alias("many")).select("a", "s", "first.*", "many"), name
    )
    whole = spans.join(contents.filter("many = 1").select("a", "s"), ["a", "s"], "left_semi").select("did", "th", "lo", "n")
    varied = contents.groupBy("a").agg(F.count("*").alias("c")).filter("c > 1")
    return whole, contents.join(varied, "a")


def collections(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Of keyed docs: ranges (did, th, lo, n) that are repeated as a whole, and the strings of all collections."""
    spans = stored(span_rows(docs, Bytes, size, gram), "byte-spans")
    fresh = spans.filter("kind <> 1")
    counts = fresh.groupBy("a").agg(F.count("*").alias("c"), F.max("kind").alias("k")).filter("c > 1 OR k > 0").select("a")
    shared = stored(fresh.join(counts, "a", "left_semi"), "byte-shared")
    whole, asked = _settled(shared, "byte-contents")
    ranges = spans.filter("kind = 1").select("did", "th", "lo", "n").unionByName(whole)
    fields = [x.split()[0] for x in STRING_SCHEMA.split(", ")]
    strings = stored(with_requests(docs, asked, "a", "lo", "n", "p", "many", "c").select("did", "th", "text", "asked").mapInArrow(_cut(size), STRING_SCHEMA), "byte-strings")
    fitting, more = strings.filter(F.col("c") <= COLLECTION), strings.filter(F.col("c") > COLLECTION)
    for wide in (CLASS, 1):
        if more.isEmpty():
            break
        # single windows are their own content: those met twice are repeated as a whole, and no group has two contents
        parts = stored(more.mapInArrow(_divided(size, wide), PART_SCHEMA), "byte-parts")
        whole, asked = _settled(parts, "byte-contents", "content")
        ranges, next_strings = ranges.unionByName(whole), asked.select(fields)
        fitting, more = fitting.unionByName(next_strings.filter(F.col("c") <= COLLECTION)), next_strings.filter(F.col("c") > COLLECTION)
    return ranges, fitting.drop("c")


def repeated_ranges(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """did, th, lo, n: windows of keyed docs that also start elsewhere, by first window and number."""
    ranges, strings = collections(docs, size, gram)
    solved = strings.repartition("a").sortWithinPartitions(*STRING_ORDER).mapInArrow(_collections(size), "did long, th long, lo int, n int")
    return ranges.unionByName(stored(solved, "byte-solved"))


TRANSFORM_SCHEMA = "collection long, strings int, col int, symbols array<int>, ordered array<int>, prefixes array<int>"


def transforms(docs: DataFrame, path: str, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Writes the collections' transforms as sequential files, a row for each column from the right, and returns them.

    symbols: what precedes each suffix (PAD: nothing), in the order of the suffixes; ordered: the strings in that order;
    prefixes: bytes that each shares with the one before. collection: the smallest anchor among its strings.
    """
    rows = keyed(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in TRANSFORM_SCHEMA.split(", ")], [pa.int64(), pa.int32(), pa.int32()] + [pa.list_(pa.int32())] * 3
        for part in _grouped(batches):
            lead = max(r[5] - r[3] for r in part)
            found: list[tuple] = []
            sink = lambda column, symbols, order, prefixes, part=part, found=found: found.append((part[0][0], len(part), column, symbols.astype(np.int32), order.astype(np.int32), prefixes[:-1]))
            for _ in column_order(aligned([r[7] for r in part], [lead - (r[5] - r[3]) for r in part]), sink):
                if len(found) * len(part) > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
                    found.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    collections(rows, size, gram)[1].repartition("a").sortWithinPartitions(*STRING_ORDER).mapInArrow(scan, TRANSFORM_SCHEMA).write.parquet(path)
    return docs.sparkSession.read.schema(TRANSFORM_SCHEMA).parquet(path)


def _strip(size: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asked")), strict=True):
                raw = (text or "").encode()
                cuts = merged([(x["lo"], x["lo"] + x["n"] + size - 1) for x in asked or ()])
                kept, at = hashlib.sha256(), 0
                for s, e in cuts:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                rows.append((did, len(raw), sum(e - s for s, e in cuts), len(cuts), kept.hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names=names)

    return scan


def suffix_dedup(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = keyed(docs)
    with cleared(docs.sparkSession) as keep:
        ranges = keep(stored(repeated_ranges(rows, size, gram), "byte-ranges"))
    release(docs.sparkSession)
    named = rows.withColumn("doc_id", F.when(F.col("did") != -(2**63), F.col("did")))
    return with_requests(named, ranges, "lo", "n", how="left").select("doc_id", "text", "asked").mapInArrow(_strip(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

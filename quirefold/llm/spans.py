"""Anchored spans: the fingerprints behind both substring operators.

Every window of `size` symbols (words or bytes) has one anchor: the leftmost minimum, by hash, among the grams inside
it. Equal windows have equal anchors at equal offsets, so only windows that share an anchor's gram can be equal.
Neighbouring windows mostly share their anchor; such a run of windows is a span, stored as one row with the anchor's
64-bit hash and a digest of the span's whole content. Two spans of equal content hold equal windows throughout, which
settles copies at one row for many windows; only anchors found with different contents need a look at single windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all runs of `gram` symbols, by doubling."""
    done, power, width, out, length = 0, mixed(symbols.astype(np.uint64) + np.uint64(1)), 1, None, len(symbols)
    while True:
        if gram & width:
            n = length - done - width + 1
            out = power[:n].copy() if out is None else mixed(out[:n] * MIX + power[done : done + n])
            done += width
        if done == gram:
            return out
        n = len(power) - width
        power = mixed(power[:n] * MIX + power[width : width + n])
        width *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` elements, in linear time."""
    n = len(x) - width + 1
    if width == 1:
        return x
    padded = np.concatenate([x, np.full(-len(x) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def find_spans(symbols: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, anchor position, first window and number of windows of each span."""
    none = np.zeros(0, np.int64)
    if len(symbols) < size:
        return none.view(np.uint64), none, none, none
    grams = gram_hashes(symbols, gram)
    ordered = (grams & HIGH) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(ordered, size - gram + 1) & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return grams[anchor[first]], anchor[first], first, np.diff(np.append(first, len(anchor)))


BASE = 0x9E3779B97F4A7C15
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as texts have needed them."""

    up = down = np.ones(1, np.uint64)

    @staticmethod
    def upto(base: int, n: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = cls.upto(BASE, max(n, 1 << 17)), cls.upto(pow(BASE, -1, 2**64), max(n, 1 << 17))
        return cls.up[:n], cls.down[:n]


class Words:
    """A text as words joined by one space; all offsets by whole-array operations."""

    def __init__(self, text: str | bytes | None):
        raw = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode(), np.uint8)
        space = SPACES[raw]
        keep = ~space
        keep[1:] |= ~space[:-1]  # of each run of white space, the first
        self.bytes, space = raw[keep], space[keep]
        if len(space) and space[-1]:
            self.bytes, space = self.bytes[:-1], space[:-1]
        self.bytes[space] = 32
        gaps = np.flatnonzero(space)
        self.starts = np.concatenate([[0], gaps + 1]) if len(space) else np.zeros(0, np.int64)
        self.ends = np.concatenate([gaps, [len(space)]]) if len(space) else np.zeros(0, np.int64)
        self.length = len(self.starts)
        self.view = memoryview(self.bytes)

    @property
    def symbols(self) -> np.ndarray:
        """64-bit hashes of the words, from running sums of bytes times powers."""
        up, down = Powers.to(len(self.bytes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes * up)])
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def slice(self, start: int, end: int) -> memoryview:
        return self.view[self.starts[start] : self.ends[end - 1]]

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _digests(self.view, self.starts[starts], self.ends[ends - 1])


class Bytes:
    """A text as UTF-8 bytes."""

    def __init__(self, text: str | None):
        self.view = memoryview((text or "").encode())
        self.length = len(self.view)
        self.symbols = np.frombuffer(self.view, np.uint8)

    def slice(self, start: int, end: int) -> memoryview:
        return self.view[start:end]

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _digests(self.view, starts, ends)


def _digests(view: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of slices."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(view[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)


SPAN_SCHEMA = "a long, s long, did long, th long, lo int, n int, p int, kind int"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
_NAMES = [x.split()[0] for x in SPAN_SCHEMA.split(", ")]


def keyed(docs: DataFrame) -> DataFrame:
    """did, th, text: rows with equal keys are the same document to these operators."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def span_rows(docs: DataFrame, unit: type, size: int, gram: int) -> DataFrame:
    """Spans of keyed docs, combined within each batch before any shuffle.

    kind 0: the batch's first span of its anchor and content. 1: a later one. 2: a first one that has later ones.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            parts, digests = [], []
            for k in np.argsort(dids, kind="stable"):
                doc = unit(batch.column(2)[int(k)].as_py())
                a, p, lo, n = find_spans(doc.symbols, size, gram)
                if not len(a):
                    continue
                digests.append(doc.digests(lo, lo + n + size - 1))
                parts.append((a.view(np.int64), np.full(len(a), dids[k]), np.full(len(a), ths[k]), lo, n, p))
            if not parts:
                continue
            a, did, th, lo, n, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            s = np.concatenate(digests)
            order = np.lexsort((np.arange(len(a)), s, a))
            head = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (s[order][1:] != s[order][:-1])])
            group = np.cumsum(head) - 1
            first = order[head][group]  # of each span in `order`, the first of its group
            same_place = (did[order] == did[first]) & (lo[order] == lo[first])  # another row with the same id isn't later
            kind = np.zeros(len(a), np.int32)
            kind[order] = np.where(head | same_place, 0, 1)
            kind[order[head]] = np.where(np.bincount(group) > 1, 2, 0)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((a, s, did, th, lo.astype(np.int32), n.astype(np.int32), p.astype(np.int32), kind), _KINDS, strict=True)], names=_NAMES)

    return docs.mapInArrow(scan, SPAN_SCHEMA)


def with_requests(docs: DataFrame, requests: DataFrame, *fields: str, how: str = "inner") -> DataFrame:
    """keyed docs with the distinct requests on each of them in one array; rows with equal keys ask once, so the document's length bounds it."""
    asked = requests.groupBy("did", "th").agg(F.collect_set(F.struct(*fields)).alias("asked"))
    return docs.join(asked.hint("shuffle_hash"), ["did", "th"], how)  # texts needn't be sorted


WINDOW_SCHEMA = "w1 long, w2 long, did long, th long, lo int, flag int"


def window_rows(asked: DataFrame, unit: type, size: int) -> DataFrame:
    """A 128-bit digest of the content of each window asked for; asked: lo, n, flag."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, dids, ths, los, flags = [], [], [], [], []

        def emitted() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(dids, pa.int64()), pa.array(ths, pa.int64()), pa.array(los, pa.int32()), pa.array(flags, pa.int32())]
            for x in (digests, dids, ths, los, flags):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "did", "th", "lo", "flag"])

        for batch in batches:
            for did, th, text, spans in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "text", "asked")), strict=True):
                doc = unit(text)
                at = sorted({(x, span["flag"]) for span in spans for x in range(span["lo"], span["lo"] + span["n"])})
                digests += [blake2b(doc.slice(x, x + size), digest_size=16).digest() for x, _ in at]
                dids += [did] * len(at)
                ths += [th] * len(at)
                los += [x for x, _ in at]
                flags += [f for _, f in at]
                if len(digests) > 100_000:
                    yield emitted()
        if digests:
            yield emitted()

    return asked.mapInArrow(scan, WINDOW_SCHEMA)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint, maximal (start, end) runs."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out

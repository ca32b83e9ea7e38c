"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every benchmark item gets a 64-bit SimHash over its words and word pairs; documents are read through windows of the
items' sizes (a geometric ladder of sizes, a small stride). The 64 bits are cut into BLOCKS blocks: two fingerprints
within RADIUS differ by at most RADIUS // BLOCKS bits in one block at least, so entering every item under all such
variants of each block finds all fingerprints within the radius. Candidates are verified by exact weighted-shingle
similarity: the share of the item's five-word shingles, with multiplicity, that the window and its margin hold.

Words are compared in lower case without ASCII punctuation, so a passage glued to marks or put in capitals is found.

The items are read in chunks of ITEM_CHUNK, each a table of bounded size shipped to the tasks and one pass over the
documents: blocks of a stated query set against all rows, so a benchmark of any size will do.

Null or empty texts and items: no rows. Items under five words: their shingles are as long as they are. Very long texts:
whole, window by window. Null doc_id or item_id: returned as null. Repeated documents and items: a row each. Ties for an
item's best window in a document: the first. Extra columns: ignored by contaminated(), kept by clean_only(), whatever
their names. Empty tables: an empty result. Rows are dropped (clean_only) by their own text alone, so null and repeated
ids take no clean row along.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import Words, mixed

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 14
BLOCKS = 4
BITS = 16  # of a block
LADDER = 1.15
#: Items in one pass: their index takes about 60 MB of a Python worker.
ITEM_CHUNK = 4000
#: Words that are looked at together, so that their bit counts stay in the cache.
PIECE = 16384
MARKS = string.punctuation.encode()
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(None, MARKS)


def word_hashes(text: str | None) -> np.ndarray:
    return Words(plain(text)).symbols


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)


class Fingerprints:
    """SimHashes of any windows, of at most `longest` words, of one sequence of words."""

    def __init__(self, hashes: np.ndarray, longest: int):
        # counts of a window are differences of running sums, so sums may wrap around as long as 2 * longest fits
        kind = np.uint8 if longest < 128 else np.uint32
        pairs = mixed(hashes[:-1] * MULTIPLIER + hashes[1:]) if len(hashes) > 1 else hashes[:0]
        self.single = _bits(hashes).astype(kind, copy=False)
        both = self.single.copy()
        both[: len(pairs)] += _bits(pairs)
        self.sums = np.zeros((len(hashes) + 1, 64), kind)
        np.cumsum(both, axis=0, dtype=kind, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        ones = self.sums[ends - 1] - self.sums[starts] + self.single[ends - 1]
        majority = (ends - starts).astype(self.sums.dtype)[:, None]  # of 2n - 1 features
        return np.packbits(ones >= majority, axis=1).view(np.uint64).ravel()

    def every(self, size: int, stride: int) -> np.ndarray:
        """Of the windows at 0, stride, 2 * stride and so on, as long as they fit."""
        n = len(self.single) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        ones = self.sums[size - 1 : size - 1 + n : stride] - self.sums[:n:stride]
        ones += self.single[size - 1 : size - 1 + n : stride]
        return np.packbits(ones >= self.sums.dtype.type(size), axis=1).view(np.uint64).ravel()


def shingles(hashes: list[int], size: int) -> Counter:
    return Counter(zip(*(hashes[i:] for i in range(size)), strict=False))


def rung(n: int) -> int:
    """The size of windows for items of n words."""
    step = round(np.log(max(1, n)) / np.log(LADDER))
    return max(1, round(LADDER**step))


class ItemIndex:
    """Items of one window size under every near variant of each block."""

    def __init__(self, numbers: list[int], prints: np.ndarray):
        self.numbers, self.prints = np.array(numbers), prints
        masks = [0] + [sum(1 << b for b in c) for k in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(BITS), k)]
        flips = np.array(masks, np.int64)
        self.tables = []
        for block in range(BLOCKS):
            part = (prints >> np.uint64(BITS * block) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            keys = (part[:, None] ^ flips[None, :]).ravel()
            owner = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(keys, kind="stable")
            self.tables.append((np.searchsorted(keys[order], np.arange((1 << BITS) + 1)).astype(np.int32), owner[order].astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into prints and item numbers of all pairs within RADIUS."""
        windows, items = [], []
        for block, (bounds, owner) in enumerate(self.tables):
            key = (prints >> np.uint64(BITS * block) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            low, count = bounds[key], bounds[key + 1] - bounds[key]
            at = np.repeat(np.arange(len(prints)), count)
            inside = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            item = owner[np.repeat(low, count) + inside]
            good = np.bitwise_count(prints[at] ^ self.prints[item]) <= RADIUS
            windows.append(at[good])
            items.append(item[good])
        pairs = np.unique(np.concatenate(windows) * len(self.numbers) + np.concatenate(items))
        return pairs // len(self.numbers), self.numbers[pairs % len(self.numbers)]


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids, self.bags, self.sizes, self.lengths = [], [], [], []
        groups: dict[int, list[int]] = {}
        prints: dict[int, list[np.uint64]] = {}
        for item_id, text in items:
            h = word_hashes(text)
            if not len(h):
                continue
            size = min(SHINGLE, len(h))
            self.ids.append(item_id)
            self.sizes.append(size)
            self.lengths.append(len(h))
            self.bags.append(shingles(h.tolist(), size))
            groups.setdefault(rung(len(h)), []).append(len(self.ids) - 1)
            prints.setdefault(rung(len(h)), []).append(Fingerprints(h, len(h)).of(np.array([0]), np.array([len(h)]))[0])
        self.indexes = {w: ItemIndex(numbers, np.array(prints[w], np.uint64)) for w, numbers in groups.items()}

    def search(self, docs: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(document, item) -> best similarity, first word and number of words of the window."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        hashes = np.concatenate(docs)
        lengths = np.array([len(d) for d in docs])
        begin = np.cumsum(lengths) - lengths
        prints = Fingerprints(hashes, max(self.indexes, default=1))
        end_of = np.repeat(begin + lengths, lengths)
        doc_of = np.repeat(np.arange(len(docs)), lengths)
        for w, index in self.indexes.items():
            stride = max(1, w // 8)
            starts = np.arange(0, max(0, len(hashes) - w + 1), stride)
            inside = starts + w <= end_of[starts]
            whole = lengths >= w
            short = ~whole & (lengths >= THRESHOLD * w * 0.8) & (lengths > 0)
            # regular windows, and for each document the first, the last, or all of a short one
            more_s = np.concatenate([begin[whole], (begin + lengths - w)[whole], begin[short]])
            more_e = np.concatenate([begin[whole] + w, (begin + lengths)[whole], (begin + lengths)[short]])
            s, e = np.concatenate([starts[inside], more_s]), np.concatenate([starts[inside] + w, more_e])
            if not len(s):
                continue
            hit, item = index.near(np.concatenate([prints.every(w, stride)[inside], prints.of(more_s, more_e)]))
            for k, i in zip(hit.tolist(), item.tolist(), strict=True):
                doc = int(doc_of[s[k]])
                low, high = int(begin[doc]), int(begin[doc] + lengths[doc])
                # the window with a margin of a stride and of what the ladder rounds off
                margin = stride + abs(w - self.lengths[i])
                a, b = max(low, int(s[k]) - margin), min(high, int(e[k]) + margin)
                found = shingles(hashes[a:b].tolist(), self.sizes[i])
                bag = self.bags[i]
                same = sum(min(c, found[g]) for g, c in bag.items() if g in found)
                value = same / sum(bag.values())
                if value >= THRESHOLD and (-value, int(s[k])) < (lambda x: (-x[0], x[1] + low) if x else (1.0, 0))(best.get((doc, i))):
                    best[doc, i] = (value, int(s[k]) - low, int(e[k] - s[k]))
        return best


def pieces(docs: list[np.ndarray]) -> Iterator[list[int]]:
    """Runs of documents of about PIECE words; a longer document stands alone."""
    run, words = [], 0
    for k, d in enumerate(docs):
        if run and words + len(d) > PIECE:
            yield run
            run, words = [], 0
        run.append(k)
        words += len(d)
    if run:
        yield run


def met(matcher: Matcher, docs: list[np.ndarray]) -> Iterator[tuple[int, int, float, int, int]]:
    """Document, item, similarity, first word, window's words: all meetings, by position in docs and in the matcher."""
    for run in pieces(docs):
        run = [k for k in run if len(docs[k])]
        if run:
            yield from ((run[d], i, *found) for (d, i), found in matcher.search([docs[k] for k in run]).items())


def chunks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items, at most ITEM_CHUNK at once."""
    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator()
    while chunk := [(r["item_id"], r["text"] or "") for r in islice(source, ITEM_CHUNK)]:
        yield chunk


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, window_words: every document and item that meet, at their best window."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, first_word long, window_words long"
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for chunk in chunks(items):
        shipped = spark.sparkContext.broadcast(chunk)

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[d], matcher.ids[i], *rest) for d, i, *rest in met(matcher, [word_hashes(t.as_py()) for t in batch.column(1)])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean_only(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose own text holds a benchmark item, in the columns they came with; ids decide nothing."""
    spark = docs.sparkSession
    at = [c.lower() for c in docs.columns].index("text")
    for chunk in chunks(items):
        shipped = spark.sparkContext.broadcast(chunk)

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in met(matcher, [word_hashes(t.as_py()) for t in batch.column(at)])]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs

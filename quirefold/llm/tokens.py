r"""Token files: ids ranked by frequency, in byte-aligned codes of one to four bytes with the lengths kept apart.

Writing. Documents are dealt by ranges of doc_id and sorted inside each range; a task tokenizes its range and writes files
of about FILE_TOKENS ids. A file is complete in itself. It counts all its ids, gives the most frequent one rank 0, and
codes ranks: a control byte holds the lengths of four codes, two bits each, and the codes' bytes follow in a run of their
own. Task attempts write under names of their own, and a table that Spark commits (the manifest) names the files that
count, so lost or repeated tasks leave nothing that is read.

    magic "QFTOKEN1", then as 64-bit integers: documents, ids, ranks, bytes of data
    the id of each rank, 32 bits        document ids, 64 bits        1 for each null document id, 8 bits
    each document's last id + 1, 64 bits        where each block of BLOCK ids begins in the data, 64 bits
    control bytes        data                                                     (all little-endian, no padding)

Reading. A control byte looks up the lengths of its four codes in a table; sums of lengths place every code of a block,
and one gather reads them all. The block table gives access to any part of a file.

Tokenizing. ASCII white space separates tokens for this kind of tokenizer whatever stands beside it, so a text's ids are
those of its words in turn, and each distinct word is encoded once for as long as a bounded table holds it; so is each
distinct part of a word between ASCII letters and marks. A vocabulary for which this doesn't hold gets whole texts.

Null text: empty, so the end id alone. Null id: written as such, before all others. Repeated rows and ties of ids: a row
each, ordered by a hash of the text; a hot id is split over ranges. Very long texts: whole.
Empty table: no files, an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cleared, delete_folder, scratch_path, stored

MAGIC = b"QFTOKEN1"
FILE_TOKENS = 1 << 24
BLOCK = 1 << 16
#: Bytes of text that are cut into words at a time (one text at least).
PIECE = 1 << 23
#: Bytes of words that a worker's table holds before it begins anew.
TABLE_BYTES = 6 << 20

#: For each control byte: the bytes of its four codes.
SIZES = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], dtype=np.uint8)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)

MANIFEST = "shard int, file int, path string, n_docs long, n_tokens long, n_bytes long"
TOKENS = "doc_id long, start long, n_tokens long, ids binary"


def encode(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data of unsigned 32-bit integers."""
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    fours = np.zeros((len(ranks) + 3) // 4 * 4, dtype=np.uint8)
    fours[: len(ranks)] = more
    return (fours.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8), data


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first n integers."""
    sizes = SIZES[control].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    padded = np.zeros(len(data) + 4, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(len(data) + 1, dtype="<u4", buffer=padded, strides=(1,))  # the four bytes from every position
    return words[ends - sizes] & _MASK[sizes]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a qualified path, and the path inside it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


class TokenFile:
    """Collects documents and writes them as one file."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.n_tokens = 0

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids.append(ids)
        self.doc_ids.append(doc_ids)
        self.nulls.append(nulls)
        self.lengths.append(lengths)
        self.n_tokens += len(ids)

    def write(self, path: str) -> tuple[int, int, int]:
        """Documents, ids and bytes written."""
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        self.ids.clear()
        counts = np.bincount(ids)
        held = np.flatnonzero(counts)
        by_rank = held[np.argsort(-counts[held], kind="stable")]  # ties by id
        rank_of = np.zeros(len(counts), dtype=np.uint32)
        rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        coded = [encode(rank_of[ids[at : at + BLOCK]]) for at in range(0, len(ids), BLOCK)]
        begins = np.cumsum([0] + [len(data) for _, data in coded], dtype="<u8")
        head = np.array([len(lengths), len(ids), len(by_rank), begins[-1]], dtype="<u8")
        tables = [head, by_rank.astype("<u4"), np.concatenate(self.doc_ids).astype("<i8"), np.concatenate(self.nulls).astype("u1"), np.cumsum(lengths, dtype="<u8"), begins[:-1]]
        fs, inside = file_system(path)
        with fs.open_output_stream(inside) as out:
            out.write(MAGIC)
            for part in chain(tables, (c for c, _ in coded), (d for _, d in coded)):
                out.write(part.tobytes())
            size = out.tell()
        return len(lengths), len(ids), size


class OpenTokens:
    """A token file open for reading: tables are read at once, ids by blocks."""

    def __init__(self, path: str) -> None:
        fs, inside = file_system(path)
        self.source = fs.open_input_file(inside)
        if self.source.read(8) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.n_docs, self.n_tokens, ranks, self.n_data = map(int, self._table("<u8", 4))
        self.by_rank = self._table("<u4", ranks)
        self.doc_ids, self.nulls, self.ends = (self._table(kind, self.n_docs) for kind in ("<i8", "u1", "<u8"))
        self.ends = self.ends.astype(np.int64)
        self.begins = np.append(self._table("<u8", -(-self.n_tokens // BLOCK)), self.n_data).astype(np.int64)
        self.control_at = self.source.tell()
        self.data_at = self.control_at + -(-self.n_tokens // 4)

    def _table(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.source.read(np.dtype(kind).itemsize * n), dtype=kind)

    def _bytes(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.source.read_at(n, at), dtype=np.uint8)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop, as unsigned 32-bit integers; reads the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        first, last = start // BLOCK, -(-stop // BLOCK)
        ids = []
        for b in range(first, last):
            n = min(BLOCK, self.n_tokens - b * BLOCK)
            control = self._bytes(self.control_at + b * BLOCK // 4, -(-n // 4))
            data = self._bytes(self.data_at + int(self.begins[b]), int(self.begins[b + 1] - self.begins[b]))
            ids.append(self.by_rank[decode(control, data, n)])
        return np.concatenate(ids)[start - first * BLOCK : stop - first * BLOCK]

    def close(self) -> None:
        self.source.close()


@cache
def tokenizer_at(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Between an ASCII letter and ASCII digits or marks but the apostrophe: no token reaches over these places.
_BETWEEN = re.compile(rb"(?<=[A-Za-z])(?=[!-&(-@\[-`{-~])|(?<=[!-&(-@\[-`{-~])(?=[A-Za-z])")
#: Small letters, ASCII or Latin-1, in UTF-8: normalized and one word for the tokenizer whatever their number.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: What shows whether a vocabulary treats words and their parts alike wherever they stand.
PROBES = ("\u00e0\u00df\u00ff\u00f6\u00f8 \u00f7 na\u00efve \u00e9t\u00e9", "The quick-Brown fox's 12.5% (sic), e\u0301!\u201d", "a1b2 \tx\n\ny  'll it's O'Neil's <tag a=b>", " ", "A", "\u00c9tat,\u00e9t\u00e9;H\u0331 \u6f22\u5b57 \u01c5x")


class Numbers(dict):
    """Numbers words as they are first asked for, and lists them."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Lists:
    """Lists of numbers, one after the other in one array."""

    def __init__(self, kind: type) -> None:
        self.flat, self.begins = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, flat: Iterable[int], lengths: list[int]) -> None:
        ends = self.begins[-1] + np.cumsum(lengths, dtype=np.int64)
        more = np.fromiter(flat, self.flat.dtype, int(ends[-1] - self.begins[-1]) if lengths else 0)
        self.flat, self.begins = np.concatenate([self.flat, more]), np.concatenate([self.begins, ends])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at the given places in a row, and where each begins in it (and the last ends)."""
        bounds = np.concatenate([[0], np.cumsum(self.begins[at + 1] - self.begins[at])])
        return self.flat[np.repeat(self.begins[at] - bounds[:-1], np.diff(bounds)) + np.arange(bounds[-1])], bounds


class WordTable:
    """Ids of texts by way of their distinct words, and of words by way of their distinct parts.

    Parts of plain letters go to the tokenizer's model in its own alphabet, all others through the whole tokenizer. A vocabulary
    for which that gives other ids than whole texts do, as PROBES show, gets whole texts.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer_at(path)
        self.model = self.tokenizer.model
        added = (re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values())
        before = self.tokenizer.pre_tokenizer
        self.letters = {c: before.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7} if before else {}
        self.whole = re.compile(b"|".join([b"'", *added]))
        self.clear()
        self.by_words = True
        self.by_words = all(self.encode(pa.array([t]))[0].tolist() == self.tokenizer.encode(t, add_special_tokens=False).ids for t in PROBES)

    def clear(self) -> None:
        self.words, self.parts = Numbers(), Numbers()
        self.parts_of, self.ids_of, self.held = Lists(np.int64), Lists(np.uint32), 0

    def learn(self) -> None:
        """Parts of the fresh words: contractions and words with added tokens are one part each.

        Letters are lowered as the tokenizer does, unless marks stand by to compose with them (U+0300 and on).
        """
        fresh = self.words.fresh
        lines = b"\n".join(fresh)
        if self.whole.search(lines):
            plain = [b"" if self.whole.search(w) else w for w in fresh]
            lines = b"\n".join(plain)
        if b"\xcc" not in lines and b"\xcd" not in lines:
            lines = lines.lower()
        cut = [line.split(b" ") if line else [word] for line, word in zip(_BETWEEN.sub(b" ", lines).split(b"\n"), fresh, strict=True)]
        sizes = list(map(len, cut))
        self.parts_of.add(map(self.parts.__getitem__, chain.from_iterable(cut)), sizes)
        new = self.parts.fresh
        simple = list(map(_LETTERS.fullmatch, new))
        rest = iter(self.tokenizer.encode_batch_fast([p.decode() for p, m in zip(new, simple) if not m], add_special_tokens=False))
        found = [[t.id for t in self.model.tokenize(p.decode().translate(self.letters))] if m else next(rest).ids for p, m in zip(new, simple)]
        self.ids_of.add(chain.from_iterable(found), list(map(len, found)))
        self.held += len(lines)
        fresh.clear()
        new.clear()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. Words are told apart by Arrow; only distinct ones are looked up."""
        if not self.by_words:
            whole = Lists(np.uint32)
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            whole.add(chain.from_iterable(found), list(map(len, found)))
            return whole.flat, np.diff(whole.begins)
        if self.held > TABLE_BYTES:
            self.clear()
        split = pc.ascii_split_whitespace(texts)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        at = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        if self.words.fresh:
            self.learn()
        parts, by_word = self.parts_of.take(at)
        here = Lists(np.uint32)
        here.flat, by_part = self.ids_of.take(parts)
        here.begins = by_part[by_word]
        ids, upto = here.take(words.indices.to_numpy())
        return ids, np.diff(upto[bounds])


@cache
def table_at(path: str) -> WordTable:
    """A Python worker's table, kept from task to task."""
    return WordTable(path)


def encoded(table: WordTable, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: how many, their ids (each text's followed by end_id), and how many ids each has."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + PIECE, side="right")))
        ids, lengths = table.encode(texts.slice(at, stop - at))
        ended = np.full(len(ids) + len(lengths), end_id, dtype=np.uint32)
        ended[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
        yield stop - at, ended, lengths + 1
        at = stop


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes token files of all documents, in ascending order of doc_id, and returns the manifest: a row for each file.

    tokenizer: path of a vocabulary file, on every executor. folder: in a store that Arrow opens (file, hdfs, s3, gs, abfs).
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    fs, inside = file_system(folder)
    fs.create_dir(inside, recursive=True)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    # the row's number splits rows that share id and text, however many, over several ranges
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "th", "row")
    ordered = dealt.sortWithinPartitions("doc_id", "th").select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out, files, shard = table_at(tokenizer), TokenFile(), 0, 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{shard:06d}-{files:05d}-{uuid.uuid4().hex}.tok"
            return pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, (shard, files, path, *out.write(path))))], schema=_MANIFEST)

        for batch in batches:
            shard = batch.column("shard")[0].as_py() if len(batch) else shard
            doc_ids, done = batch.column("doc_id"), 0
            plain, nulls = doc_ids.fill_null(0).to_numpy(), np.asarray(doc_ids.is_null())
            for n, ids, lengths in encoded(table, batch.column("text"), end_id):
                out.add(plain[done : done + n], nulls[done : done + n], ids, lengths)
                done += n
                if out.n_tokens >= file_tokens:
                    yield flush()
                    out, files = TokenFile(), files + 1
        if out.n_tokens:
            yield flush()

    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
_TOKENS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def qualified(spark: SparkSession, folder: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_starts(manifest: DataFrame) -> DataFrame:
    """path and start: the ids in all files before. Totals of shards first (as many as Spark had partitions), then files of a shard."""
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    shards = shards.select("shard", F.coalesce(F.sum("total").over(before.orderBy("shard")), F.lit(0)).alias("shard_start"))
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy("shard").orderBy("file")), F.lit(0))
    return manifest.select("shard", "path", inside.alias("inside")).join(shards, "shard").select("path", (F.col("shard_start") + F.col("inside")).alias("start"))


def read_tokens(manifest: DataFrame, batch_tokens: int = 1 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers) of each document."""
    spark = manifest.sparkSession
    files = manifest.count()
    # a task reads whole files; said plainly, since small rows would otherwise be gathered into few tasks
    dealt = file_starts(manifest).repartition(max(1, min(files, 4 * spark.sparkContext.defaultParallelism)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                tokens = OpenTokens(path)
                bounds, first = np.append(0, tokens.ends), 0
                while first < tokens.n_docs:
                    last = max(first + 1, int(np.searchsorted(tokens.ends, bounds[first] + batch_tokens, side="right")))
                    ids = tokens.ids(int(bounds[first]), int(bounds[last])).tobytes()
                    cuts = (4 * (bounds[first : last + 1] - bounds[first])).tolist()
                    columns = [pa.array(tokens.doc_ids[first:last], pa.int64(), mask=tokens.nulls[first:last] == 1), pa.array(bounds[first:last] + start), pa.array(np.diff(bounds[first : last + 1])), pa.array([ids[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_TOKENS)
                    first = last
                tokens.close()

    return dealt.mapInArrow(read, TOKENS)


def word_bpe() -> str:
    """The installed vocabulary of the contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_report(docs: DataFrame, tokenizer: Callable[[], str] = word_bpe, end_id: int = 1) -> DataFrame:
    """The contract's row for each document, from files written into the shared folder and read back; the files go then."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    with cleared(spark) as keep:
        try:
            found = read_tokens(write_tokens(docs, folder, tokenizer(), end_id))
            return keep(stored(found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-report"))
        finally:
            delete_folder(spark, folder)

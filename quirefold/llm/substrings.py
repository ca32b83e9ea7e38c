"""Substring dedup over a log-structured fingerprint index.

The index is a list of immutable runs: the first span of every anchor and content seen in one batch, bucketed and sorted
by anchor hash. A new batch is written as a run of its own and merge-joined with the earlier ones, bucket by bucket, so
that only the batch moves. Spans whose anchor and content digest are known, or came earlier in the batch, are repeats.
Where an anchor is known with other contents, the single windows of those spans are compared by a 128-bit digest of their
words, fetched again from the documents: the verification. Once there are more than max_runs runs they are compacted into
one. save() leaves a manifest, and open() goes on from there in another session.

Earlier means: in an earlier batch, or with a smaller doc_id in the same batch, or earlier in the same document.

Null text: no words. Empty and short texts: nothing removed. Very long texts: whole. Null doc_id: counts as the smallest
id. Ties: rows with the same id and text are the same place, so neither removes the other, and each gets its row. Rows
with the same id and other text: compared by position. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_folder, drop_stored, scratch_path, stored
from .spans import Words, keyed, merged, span_rows, window_rows, with_requests

WINDOW = 20
GRAM = 10
BATCHES = 4
MAX_RUNS = 2
RUN_SCHEMA = "seq int, did long, lo int, a long, s long, th long, n int"


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Lets Spark rely on the order of runs where each bucket is one sorted file, so that merging them needs no sort."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class FingerprintIndex:
    """path: a folder on storage that driver and executors share. buckets: of every run, the same for all of them."""

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, max_runs: int = MAX_RUNS, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.window, self.gram, self.max_runs = window, gram, max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, str]] = []  # table, folder
        self.documents: list[DataFrame] = []  # keyed documents of each batch, for verification

    @classmethod
    def open(cls, spark: SparkSession, path: str, documents: list[DataFrame], max_runs: int = MAX_RUNS) -> FingerprintIndex:
        """The index that save() left in path. documents: the keyed documents of its batches, in their order."""
        saved = [json.loads(r["value"]) for r in spark.read.text(f"{path}/manifest-*").collect()]
        last = max(saved, key=lambda m: m["batches"])
        if last["batches"] != len(documents):
            raise ValueError(f"the index holds {last['batches']} batches of documents")
        index = cls(spark, path, last["window"], last["gram"], max_runs, last["buckets"])
        index.documents = list(documents)
        for name in last["runs"]:
            table = f"run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {table} ({RUN_SCHEMA}) USING parquet CLUSTERED BY (a) SORTED BY (a, s) INTO {index.buckets} BUCKETS LOCATION '{path}/{name}'")
            index.runs.append((table, name))
        return index

    def save(self) -> None:
        manifest = {"batches": len(self.documents), "window": self.window, "gram": self.gram, "buckets": self.buckets, "runs": [name for _, name in self.runs]}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{len(self.documents)}-{uuid.uuid4().hex}")

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        table, name = f"run_{uuid.uuid4().hex}", f"run-{uuid.uuid4().hex}"
        sorted_rows = rows.repartition(self.buckets, "a").sortWithinPartitions("a", "s")
        sorted_rows.write.bucketBy(self.buckets, "a").sortBy("a", "s").format("parquet").option("path", f"{self.path}/{name}").saveAsTable(table)
        return table, name

    def drop(self, *runs: tuple[str, str]) -> None:
        """Deletes runs, all of them if none is named."""
        for table, name in runs or tuple(self.runs):
            self.spark.sql(f"DROP TABLE {table}")
            delete_folder(self.spark, f"{self.path}/{name}")
        self.runs = [r for r in self.runs if runs and r not in runs]

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds keyed documents (did, th, text). Returns did, th, lo, n: windows found earlier, by first window and number."""
        seq = len(self.documents)
        spans = stored(span_rows(docs, Words, self.window, self.gram), "spans")
        fresh = self._write(spans.filter("kind <> 1").select(F.lit(seq).alias("seq"), "did", "lo", "a", "s", "th", "n"))
        batch, anchors = self.spark.table(fresh[0]), self.spark.table(fresh[0]).select("a")
        # anchors met at least twice; most are met once, and all further steps leave those out
        again = anchors.groupBy("a").agg(F.count("*").alias("c")).filter("c > 1").select("a")
        hits = None
        if self.runs:
            with _sorted_scans(self.spark):
                hits = stored(_union([self.spark.table(table).join(anchors.hint("merge"), "a", "left_semi") for table, _ in self.runs]), "hits")
            again = again.unionByName(hits.select("a").distinct())
        mine = batch.join(again.hint("shuffle_hash"), "a", "left_semi")
        shared = stored(mine.unionByName(hits.select(*mine.columns)) if hits is not None else mine, "shared")
        place = F.struct("seq", "did", "lo")
        firsts = stored(
            shared.groupBy("a", "s").agg(F.min(F.struct("seq", "did", "lo")).alias("first")).select("a", "s", "first.*"),
            "firsts",
        )
        key = firsts.select("a", "s", F.struct("seq", "did", "lo").alias("first"))
        placed = shared.join(key.hint("shuffle_hash"), ["a", "s"])
        repeats = placed.filter((F.col("seq") == seq) & (place > F.col("first"))).select("did", "th", "lo", "n")
        varied = firsts.groupBy("a").agg(F.min("s").alias("s0"), F.max("s").alias("s1")).filter("s0 <> s1").select("a")
        # firsts, and rows with another text under the same id and place, which get the same verdict
        asked = placed.filter(place == F.col("first")).join(varied.hint("shuffle_hash"), "a").select("seq", "did", "th", "lo", "n", F.col("seq").alias("flag"))
        documents = _union([d.select("did", "th", "text").withColumn("seq", F.lit(k)) for k, d in enumerate([*self.documents, docs])])
        requests = asked.groupBy("seq", "did", "th").agg(F.collect_set(F.struct("lo", "n", "flag")).alias("asked"))
        found = documents.join(requests.hint("shuffle_hash"), ["seq", "did", "th"])
        windows = stored(window_rows(found.select("did", "th", "text", "asked"), Words, self.window), "windows")
        at = F.struct(F.col("flag"), F.col("did"), F.col("lo"))
        earliest = windows.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
        verified = windows.filter(F.col("flag") == seq).join(earliest.hint("shuffle_hash"), ["w1", "w2"]).filter(at > F.col("first")).select("did", "th", "lo", F.lit(1).alias("n"))
        removed = stored(spans.filter("kind = 1").select("did", "th", "lo", "n").unionByName(repeats).unionByName(verified), "removed")
        self.documents.append(docs)
        self.runs.append(fresh)
        if len(self.runs) > self.max_runs:
            self.compact()
        drop_stored(spans, shared, firsts, windows, *([hits] if hits is not None else []))  # nothing reads them any more
        return removed

    def compact(self) -> None:
        """All runs as one: the first place of every anchor and content."""
        old = list(self.runs)
        rows = _union([self.spark.table(table) for table, _ in old])
        merged = rows.groupBy("a", "s").agg(F.min(F.struct("seq", "did", "lo", "th", "n")).alias("first")).select("first.seq", "first.did", "first.lo", "a", "s", "first.th", "first.n")
        self.runs.append(self._write(merged))
        self.drop(*old)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _strip(window: int):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asked")), strict=True):
                words = (text or "").encode().split()
                kept, at = [], 0
                for s, e in merged([(x["lo"], x["lo"] + x["n"] + window - 1) for x in asked or ()]):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                rows.append((did, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    return scan


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256. Documents enter the index in `batches` batches by ascending doc_id."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, scratch_path(spark, "index"), window, gram)
    rows = keyed(docs)
    bounds = rows.agg(F.percentile_approx("did", [k / batches for k in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else []
    bounds = sorted(set(bounds or []))
    removed = []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = rows
        if low is not None:
            part = part.filter(F.col("did") > low)
        if high is not None:
            part = part.filter(F.col("did") <= high)
        removed.append(index.add(part))
    index.drop()
    keyed_docs = rows.withColumn("doc_id", F.when(F.col("did") != -(2**63), F.col("did")))
    return with_requests(keyed_docs, _union(removed), "lo", "n", how="left").select("doc_id", "text", "asked").mapInArrow(_strip(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")

"""Near-duplicate detection by Order MinHash.

A document's five-word shingles are labelled with their occurrence number. Each sketch takes the PICKS smallest of
them under one hash and keeps them in text order, so a sketch agrees for texts that share shingles in the same order.
As many sketches again take the PICKS smallest distinct shingles without their order, so they agree for texts with moved
or repeated parts too. Documents that agree in a sketch are candidates. Equal word sequences are one text from the start.

A candidate pair is verified by a banded alignment of its words: of the three-word runs that both texts hold, counted by
occurrence and at most a fifth of the longer text apart, the longest chain in the order of both. The pair is linked if
the chain covers four fifths of the longer text's words. Pairs that fail there are linked if they share four fifths of
their distinct five-word shingles, so that moved or repeated parts don't part them.

The smallest document of each group that agrees in a sketch leads it, and all documents of one leader form a cluster, so
candidates always meet in one. First every text is aligned with its leader, one after another: most clusters are settled
then, whatever their size. Where a cluster keeps texts that aren't linked to their leader, those are compared with each
other and with the rest; pairs that are linked already are skipped. They are dealt in blocks of bounded bytes and rows,
a task for each pair of blocks, so no pair goes unseen.

Null and empty texts: all equal, one class. Texts under five words: only equal ones match. Very long texts: whole.
Null doc_id: counts as the smallest id and comes back as null; rows without an id are documents of their own. Repeated
rows: copies of each other. Ties: of equal or linked texts the smallest id, then the smallest hash of the text, stands for
the class. Rows that share an id are one document, in one class; one_of_each decides by texts alone and keeps a row of
each class. Extra columns are ignored (near_duplicates) or kept (one_of_each). Empty table: an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cleared, release, row_key, stored
from .spans import Words, gram_hashes, mixed

SHINGLE = 5
THRESHOLD = 0.8
#: Words that must stand together in both texts for an alignment to keep them.
RUN = 3
PICKS = 3
#: Sketches in text order, and as many without order.
BANDS = 20
#: Bytes and rows of text in one block of a cluster.
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 512
#: Parts over which the rows of one cluster are spread in joins.
SALTS = 16
SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often each shingle stood before, in text order."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
    number = np.empty(len(hashes), np.uint64)
    number[order] = (np.arange(len(ranked)) - start).astype(np.uint64)
    return number


def labelled(hashes: np.ndarray, number: np.ndarray | None = None) -> np.ndarray:
    """Shingle hashes made distinct by occurrence number, in text order."""
    return mixed(hashes + (occurrences(hashes) if number is None else number) * np.uint64(0x9E3779B97F4A7C15))


def sketches(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit value for each sketch of a text's shingle hashes: BANDS in text order, BANDS without order."""
    number = occurrences(hashes)
    shingles, first = labelled(hashes, number), number == 0
    distinct = shingles if first.all() else shingles[first]

    def least(values: np.ndarray, seed: np.uint64) -> np.ndarray:
        return np.argpartition(mixed(values ^ seed), PICKS - 1)[:PICKS] if PICKS < len(values) else np.arange(len(values))

    def digest(picked: np.ndarray, salt: bytes = b"") -> int:
        return int.from_bytes(blake2b(picked.tobytes(), digest_size=8, salt=salt).digest(), "little", signed=True)

    ordered, plain = [], []
    for seed in SEEDS:
        at = np.sort(least(shingles, seed))
        ordered.append(digest(shingles[at]))
        plain.append(digest(np.sort(shingles[at] if distinct is shingles else distinct[least(distinct, seed)]), b"set"))
    return ordered + plain


def text_shingles(text: str | None) -> tuple[Words, np.ndarray]:
    doc = Words(text)
    return doc, gram_hashes(doc.symbols, SHINGLE) if doc.length >= SHINGLE else np.zeros(0, np.uint64)


class Text:
    """What comparing needs of one text."""

    def __init__(self, text: str):
        doc, self.shingles = text_shingles(text)
        self.length = doc.length
        self.runs = labelled(gram_hashes(doc.symbols, RUN))
        self.distinct = np.unique(self.shingles)
        self._order: np.ndarray | None = None

    def found(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the runs stand in this text, and where."""
        if self._order is None:
            self._order = np.argsort(self.runs)
            self._ranked = self.runs[self._order]
        at = np.minimum(np.searchsorted(self._ranked, runs), len(self._ranked) - 1)
        here = np.flatnonzero(self._ranked[at] == runs)
        return here, self._order[at[here]]


def chain(j: np.ndarray) -> np.ndarray:
    """Indices of a longest increasing subsequence of distinct numbers."""
    if (j[1:] > j[:-1]).all():
        return np.arange(len(j))
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, x in enumerate(j.tolist()):
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
        ends[at : at + 1] = [k]
        before.append(ends[at - 1] if at else -1)
    out, k = [], ends[-1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return np.array(out[::-1])


def kept_words(a: Text, b: Text) -> int:
    """Words that the banded alignment of two texts keeps."""
    band = (1 - THRESHOLD) * max(a.length, b.length)
    j, i = a.found(b.runs)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if not len(i):
        return 0
    of = chain(i)
    return min(RUN + int(np.minimum(np.diff(x[of]), RUN).sum()) for x in (i, j))


def aligned(a: Text, b: Text) -> bool:
    longest = max(a.length, b.length)
    return min(a.length, b.length) >= THRESHOLD * longest - 1e-9 and kept_words(a, b) >= THRESHOLD * longest - 1e-9


def linked(a: Text, b: Text) -> bool:
    """Whether two texts are near duplicates."""
    if aligned(a, b):
        return True
    common = len(np.intersect1d(a.distinct, b.distinct, assume_unique=True))
    return common > 0 and common >= THRESHOLD * (len(a.distinct) + len(b.distinct) - common)


class Shared:
    """For one of many sequences of distinct elements: how much of others is shared with it, `cover` places for each element."""

    def __init__(self, sequences: list[np.ndarray], cover: int = 1):
        self.cover = cover
        self.sizes = np.array([len(s) + cover - 1 for s in sequences])
        self.starts = np.cumsum(self.sizes) - self.sizes
        known, codes = np.unique(np.concatenate(sequences), return_inverse=True)
        self.present = np.zeros(len(known) + 1, bool)
        self.codes = np.full(self.sizes.sum(), len(known))  # between sequences, places that are never shared
        self.codes[np.concatenate([np.arange(s, s + n - cover + 1) for s, n in zip(self.starts, self.sizes, strict=True)])] = codes

    def of(self, x: int, others: np.ndarray) -> np.ndarray:
        mine = self.codes[self.starts[x] : self.starts[x] + self.sizes[x] - self.cover + 1]
        self.present[mine] = True
        lengths = self.sizes[others]
        begins = np.cumsum(lengths) - lengths
        at = np.repeat(self.starts[others] - begins, lengths) + np.arange(lengths.sum())
        shared = self.present[self.codes[at]]
        self.present[mine] = False
        covered = shared.copy()
        for k in range(1, self.cover):
            covered[k:] |= shared[:-k]
        hits = np.concatenate([[0], np.cumsum(covered)])
        return hits[begins + lengths] - hits[begins]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts, found = [], [], []
        for text in batch.column(1):
            doc, shingles = text_shingles(text.as_py())
            keys.append(blake2b(doc.view, digest_size=16).digest())
            counts.append(len(shingles))
            found.append(sketches(shingles) if len(shingles) else [])
        halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(counts, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["did", "th", "k1", "k2", "n", "sketch"])


def components(edges: DataFrame) -> DataFrame:
    """u, root: the smallest id in u's component, for every u in edges (u, v). Alternates large-star and small-star steps."""
    now = stored(edges.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("shuffle_hash"), "u").filter("v > u").selectExpr("v AS u", "m AS v")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        after = large.join(small.hint("shuffle_hash"), "u").filter("v <> m").selectExpr("v AS u", "m AS v").unionByName(small.selectExpr("u", "m AS v"))
        now = stored(after.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def _with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, part, uid, text) sorted by cluster, part, uid <> cluster -> cluster, uid, linked, bytes. Holds the leader and one text."""
    leader = key = None
    for batch in batches:
        found: list[tuple] = []
        for cluster, part, uid, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            mine = Text(text)
            if (cluster, part) != key:
                key, leader = (cluster, part), mine
                if part:
                    continue  # the leader itself is reported once, by the first part
            found.append((cluster, uid, mine is leader or linked(leader, mine), len(text)))
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["cluster", "uid", "linked", "bytes"])


def links_of(texts: list[Text], labels: list[int], allowed: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs of linked texts that meet in a sketch, enough of them to connect all of those; equal labels: linked already."""
    parent = list(range(len(texts)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first: dict[int, int] = {}
    for k, label in enumerate(labels):
        parent[k] = first.setdefault(label, k)
    runs, sets = Shared([t.runs for t in texts], RUN), Shared([t.distinct for t in texts])
    lengths = np.array([t.length for t in texts])
    out: list[tuple[int, int]] = []
    buckets: dict[tuple[int, int], dict[int, list[int]]] = {}  # of each sketch value, the texts so far by what they are linked to
    for x, mine in enumerate(texts):
        met = [buckets.setdefault(key, {}) for key in enumerate(sketches(mine.shingles))]
        tested: set[int] = set()
        # first one text of each group that has met x, then all others of groups that are still apart
        for leaders in (True, False):
            wanted: set[int] = set()
            for bucket in met:
                for root in list(bucket):
                    now = find(root)
                    if now != root:
                        bucket.setdefault(now, []).extend(bucket.pop(root))
                for root, members in bucket.items():
                    if root != find(x):
                        wanted.update(members[:1] if leaders else members)
            others = np.array(sorted(y for y in wanted - tested if allowed(x, y)), np.int64)
            tested |= wanted
            if not len(others):
                continue
            # an alignment keeps no more words than runs of both texts cover
            alignable = np.minimum(runs.of(x, others), lengths[x]) >= THRESHOLD * np.maximum(lengths[others], lengths[x]) - 1e-9
            common = sets.of(x, others)
            moved = common >= THRESHOLD * (sets.sizes[others] + sets.sizes[x] - common)
            for y, a, m in zip(others.tolist(), alignable.tolist(), moved.tolist(), strict=True):
                if (a or m) and find(x) != find(y) and (m or aligned(texts[y], mine)):
                    out.append((y, x))
                    parent[find(x)] = find(y)
        for bucket in met:
            bucket.setdefault(find(x), []).append(x)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j, block, led, uid, text) sorted by cluster, i, j -> links u, v. Holds two blocks at most."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        inside = rows[0][1] == rows[0][2]
        rows = sorted(set(rows), key=lambda r: r[5])
        blocks, ids = [r[3] for r in rows], [r[5] for r in rows]
        labels = [-1 if r[4] else k for k, r in enumerate(rows)]  # those linked to the leader are linked to each other
        return [(ids[y], ids[x]) for y, x in links_of([Text(r[6]) for r in rows], labels, lambda x, y: inside or blocks[x] != blocks[y])]

    group: list[tuple] = []
    out: list[tuple[int, int]] = []

    def emitted() -> pa.RecordBatch:
        us, vs = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if group and row[:3] != group[0][:3]:
                out += solve(group)
                group = []
                if len(out) > 10_000:
                    yield emitted()
            group.append(row)
    if group:
        out += solve(group)
    if out:
        yield emitted()


def salted(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """rows joined with one narrow row for each cluster, without gathering a cluster's rows."""
    many = narrow.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(many.hint("shuffle_hash"), ["cluster", "salt"]).drop("salt")


def _pieces(size: str, n: str) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(F.col(size) / BLOCK_BYTES), F.ceil(F.col(n) / BLOCK_ROWS)).cast("int")


def link_members(members: DataFrame, parts: int) -> DataFrame:
    """u, v: links between members (cluster, uid, text) of clusters, the cluster being its leader's uid."""
    sizes = members.groupBy("cluster").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).select("cluster", _pieces("size", "n").alias("parts"))
    dealt = salted(members, sizes).withColumn("part", F.when(F.col("uid") == F.col("cluster"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))))
    led = dealt.select("cluster", F.explode("part").alias("part"), "uid", "text").repartition(parts, "cluster", "part").sortWithinPartitions("cluster", "part", F.col("uid") != F.col("cluster"))
    verdicts = stored(led.mapInArrow(_with_leader, "cluster long, uid long, linked boolean, bytes long"), "verdicts")
    size = lambda which: F.sum(F.when(which, F.col("bytes")).otherwise(0))
    count = lambda which: F.count(F.when(which, 1))
    yes, no = F.col("linked"), ~F.col("linked")
    # what is left are clusters with a text that isn't linked to its leader, and one beside the leader to link it to
    rest = verdicts.groupBy("cluster").agg(size(yes).alias("s1"), count(yes).alias("n1"), size(no).alias("s0"), count(no).alias("n0")).filter("n0 > 0 AND n0 + n1 > 2")
    rest = rest.select("cluster", _pieces("s0", "n0").alias("apart"), _pieces("s1", "n1").alias("led"))
    unsettled = salted(members, rest).join(verdicts.select("cluster", "uid", "linked").hint("shuffle_hash"), ["cluster", "uid"]).filter("linked IS FALSE OR uid <> cluster")
    # blocks 0 .. apart - 1 hold texts apart from the leader, those from apart on texts linked to it; the latter meet only the former
    block = F.when(no, F.pmod(F.xxhash64("uid"), F.col("apart"))).otherwise(F.col("apart") + F.pmod(F.xxhash64("uid"), F.col("led"))).cast("int")
    placed = unsettled.withColumn("block", block)
    others = F.when(no, F.sequence(F.lit(0), F.col("apart") + F.col("led") - 1)).otherwise(F.sequence(F.lit(0), F.col("apart") - 1))
    tasks = placed.withColumn("other", F.explode(others)).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("linked").alias("led"), "uid", "text")
    links = tasks.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_compare, "u long, v long")
    return verdicts.filter("linked AND uid <> cluster").select(F.col("cluster").alias("u"), F.col("uid").alias("v")).unionByName(links)


def classes(docs: DataFrame, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """What _classes finds, with no other table left behind."""
    with cleared(docs.sparkSession) as keep:
        numbered, texts = _classes(docs, by_id)
        found = keep(numbered), keep(stored(texts, "classes"))
    release(docs.sparkSession)
    return found


def _classes(docs: DataFrame, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Rows as did, th (row_key), uid; and texts as uid, text (the smallest did, th with these words), root (the smallest of its class).

    by_id: rows that share an id, if it isn't null, are in one class.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).select(*row_key(), "text")
    scanned = stored(rows.select("did", "text", "th").mapInArrow(_sketch, "did long, th long, k1 long, k2 long, n int, sketch array<long>"), "sketches")
    least = scanned.groupBy("k1", "k2").agg(F.min(F.struct("did", "th")).alias("text"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    texts = stored(least.withColumn("uid", F.monotonically_increasing_id()), "texts")  # numbers stay once they are written
    buckets = texts.filter("n > 0").select("uid", F.posexplode("sketch").alias("band", "value"))
    leaders = buckets.groupBy("band", "value").agg(F.min("uid").alias("lead"), F.count("*").alias("c")).filter("c > 1")
    clusters = buckets.join(leaders.hint("shuffle_hash"), ["band", "value"]).select(F.col("lead").alias("cluster"), "uid").distinct()
    wanted = clusters.join(texts.select("uid", "text.did", "text.th").hint("shuffle_hash"), "uid")
    # a row for each did and th, so that neither repeated rows nor null ids gather
    whole = rows.groupBy("did", "th").agg(F.first("text").alias("text"))
    full = stored(whole.join(wanted.hint("shuffle_hash"), ["did", "th"]).select("cluster", "uid", F.coalesce("text", F.lit("")).alias("text")), "members")
    # a few bytes mean much work here, so tasks aren't merged by size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    links = stored(link_members(full, parts), "links")
    numbered = stored(scanned.select("did", "th", "k1", "k2").join(texts.select("k1", "k2", "uid").hint("shuffle_hash"), ["k1", "k2"]).select("did", "th", "uid"), "numbered")
    if by_id:
        ends = numbered.filter(F.col("did") != NULL_ID).groupBy("did").agg(F.min("uid").alias("u"), F.max("uid").alias("v")).filter("u < v").select("did", "u")
        links = links.unionByName(numbered.join(ends.hint("shuffle_hash"), "did").select("u", F.col("uid").alias("v")).filter("u <> v"))
    linked = texts.select("uid", "text").join(components(links).withColumnRenamed("u", "uid").hint("shuffle_hash"), "uid")
    roots = linked.groupBy("root").agg(F.min("text").alias("least"))
    found = linked.select("uid", F.col("root")).join(roots.hint("shuffle_hash"), "root").select("uid", "least")
    out = texts.select("uid", "text").join(found.hint("shuffle_hash"), "uid", "left").select("uid", "text", F.coalesce("least", "text").alias("root"))
    return numbered, out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), text_id (the smallest doc_id with the same words)."""
    rows, texts = classes(docs, True)
    out = rows.join(texts.select("uid", F.col("text.did").alias("text"), F.col("root.did").alias("root")).hint("shuffle_hash"), "uid")
    named = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(named("did").alias("doc_id"), named("root").alias("class_id"), named("text").alias("text_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class: that with the smallest id, then the smallest hash of its text, then the smallest other columns."""
    _, texts = classes(docs, False)
    kept = texts.filter("text = root").select("text.did", "text.th")
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    return keyed.groupBy("did", "th").agg(F.min("row").alias("row")).join(kept.hint("shuffle_hash"), ["did", "th"], "left_semi").select("row.*")

r"""Vector codes: product quantization by k-means on integers, with bounds that skip most scans of the codebooks.

A vector is cut into PARTS parts, each with a codebook of its own. A full scan of a part's codebook leaves a lower bound
on the distance to every entry but the nearest, and the round it was made in: the bound's stamp. All codebooks of earlier
rounds are kept, so later the bound is lowered by how far entries lie from where they stood at the stamp: the norm of
the sum of their moves, which is at most the sum of the norms. A part whose distance to its own entry is below that is
settled; all others are scanned again, and their bounds and stamps renewed. Distances are exact integers, bounds
are rounded to the safe side and compared strictly, so ties are always scanned.

Each round is one pass over a stored table; what a round sends to the driver are sums and counts of the codebooks'
entries, whose number is fixed. A table of states is deleted when the next one is written.

Vectors that are null, or hold null or non-finite components: dropped. Vectors whose length isn't that of the smallest
kept id's: dropped. A length that PARTS doesn't divide: zeros follow (they add nothing to any distance). Components
beyond LIMIT are set to it, as squared errors would not fit 64 bits (at 64 components: an absolute value of 524,288).
Null ids: allowed, after all others. Fewer vectors than entries: so many entries. Repeated ids: first entries by vector.
Repeated vectors, ties: the lower index. Empty table: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleared, delete_folder, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Relative slack of bounds, far above what square roots and sums of doubles lose.
SLACK = 2.0**-44

STATE = "vec_id long, label string, q array<int>, code binary, lower binary, stamp binary, scans int"
CODED = "vec_id long, label string, code binary, error long, scans int"


def limit(length: int) -> int:
    """Components up to this have squared distances of whole vectors below 2**62."""
    return math.isqrt((1 << 62) // max(length, 1)) // 2 - 1


def kept_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, q (whole vectors as integers) of the rows that stay; the label as text, only ever compared."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    label = F.col("label").cast("string") if "label" in table.columns else F.lit(None).cast("string")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x")).filter(F.col("x").isNotNull() & whole & (F.size("x") > 0))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select(F.size("x")).first()
    length = first[0] if first else 0
    most = float(limit(length))
    q = F.transform("x", lambda v: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), v * SCALE))).cast("int"))
    return rows.filter(F.size("x") == length).select("vec_id", "label", q.alias("q"))


def cut(q: pa.Array) -> np.ndarray:
    """Vectors, parts, components of a part."""
    n = len(q)
    flat = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    length = len(flat) // max(n, 1)
    wide = -(-length // PARTS)
    out = np.zeros((n, PARTS * wide), dtype=np.int64)
    out[:, :length] = flat.reshape(n, length)
    return out.reshape(n, PARTS, wide)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors from entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # so all sums are integers that doubles hold
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    found = np.zeros((len(x), len(entries)), dtype=np.int64)
    for d in range(x.shape[1]):
        found += (x[:, d, None] - entries[None, :, d]) ** 2
    return found


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, and a lower bound on the distance to any other."""
    distance = squares(x, entries)
    code = distance.argmin(axis=1)
    distance[np.arange(len(x)), code] = np.iinfo(np.int64).max
    others = distance.min(axis=1).astype(np.float64) if len(entries) > 1 else np.full(len(x), np.inf)
    return code.astype(np.uint8), np.sqrt(others) * (1 - SLACK)


def net_moves(history: list[np.ndarray]) -> np.ndarray:
    """stamp, part, entry: an upper bound on how far any other entry stands now from where it stood at the stamp."""
    now = history[-1]
    moved = np.stack([np.sqrt(((now - then).astype(np.float64) ** 2).sum(axis=2)) for then in history]) * (1 + SLACK)
    if now.shape[1] == 1:
        return np.zeros_like(moved)
    order = np.sort(moved, axis=2)
    return np.where(moved == order[:, :, -1:], np.where(order[:, :, -2:-1] == order[:, :, -1:], order[:, :, -1:], order[:, :, -2:-1]), order[:, :, -1:])


def reassigned(x: np.ndarray, history: list[np.ndarray], code: np.ndarray, lower: np.ndarray, stamp: np.ndarray, known: bool) -> np.ndarray:
    """Brings code, lower and stamp (vectors by parts) up to the last codebooks, in place; how many parts of each vector were scanned."""
    now, scans = history[-1], np.zeros(len(x), dtype=np.int32)
    moves = net_moves(history)
    for p in range(PARTS):
        again = np.ones(len(x), dtype=bool)
        if known:
            own = ((x[:, p] - now[p][code[:, p]]) ** 2).sum(axis=1)
            again = np.sqrt(own.astype(np.float64)) * (1 + SLACK) >= lower[:, p] - moves[stamp[:, p], p, code[:, p]]
        if again.any():
            code[again, p], lower[again, p] = scan(x[again, p], now[p])
            stamp[again, p] = len(history) - 1
            scans += again
    return scans


def _fixed(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column of PARTS numbers a row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, PARTS).copy()


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def assign(states: DataFrame, history: list[np.ndarray], last: bool) -> DataFrame:
    """One round over all vectors: new states, or codes and errors if it is the last. Without a code column: the first round."""
    known = "code" in states.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = cut(batch.column("q"))
            if known:
                code, lower, stamp = _fixed(batch.column("code"), np.uint8), _fixed(batch.column("lower"), np.float64), _fixed(batch.column("stamp"), np.uint8)
                before = batch.column("scans").to_numpy()
            else:
                code, stamp = np.zeros((len(x), PARTS), np.uint8), np.zeros((len(x), PARTS), np.uint8)
                lower, before = np.zeros((len(x), PARTS)), 0
            scans = pa.array((reassigned(x, history, code, lower, stamp, known) + before).astype(np.int32))
            ids = [batch.column("vec_id"), batch.column("label")]
            if last:
                error = sum(((x[:, p] - history[-1][p][code[:, p]]) ** 2).sum(axis=1) for p in range(PARTS))
                columns, schema = [*ids, _packed(code), pa.array(error, pa.int64()), scans], CODED
            else:
                columns, schema = [*ids, batch.column("q"), _packed(code), _packed(lower), _packed(stamp), scans], STATE
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return states.mapInArrow(step, CODED if last else STATE)


def sums(states: DataFrame, entries: int, wide: int) -> DataFrame:
    """part, entry, n and the sum of each component, added up inside tasks first: at most a row for each entry and task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, wide), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x, code = cut(batch.column("q")), _fixed(batch.column("code"), np.uint8)
            for p in range(PARTS):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                for d in range(wide):  # doubles hold these sums: a batch's rows times LIMIT stay below 2**53
                    totals[p, :, d] += np.bincount(code[:, p], weights=x[:, p, d], minlength=entries).astype(np.int64)
        part, entry = np.nonzero(counts)
        rows = [{"part": p, "entry": e, "n": int(counts[p, e]), "s": totals[p, e].tolist()} for p, e in zip(part.tolist(), entry.tolist())]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    partial = states.select("q", "code").mapInArrow(add, "part int, entry int, n long, s array<long>")
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(wide)))


def first_codebooks(vectors: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """part, entry, component: the parts of the smallest ids' vectors (so many rows reach the driver, whatever the table)."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    return cut(pa.array([r.q for r in rows], pa.list_(pa.int32()))).transpose(1, 0, 2) if rows else np.zeros((PARTS, 0, 0), np.int64)


def moved_codebooks(states: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Each entry at the floor of its parts' mean; unused entries stay."""
    found = codebooks.copy()
    for r in sums(states, codebooks.shape[1], codebooks.shape[2]).collect():
        found[r.part, r.entry] = [int(r[f"s{d}"]) // r.n for d in range(codebooks.shape[2])]
    return found


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compressed(table: DataFrame, vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """A stored table of vec_id, label, code (a byte for each part), error and scans (codebooks scanned), and all codebooks so far."""
    states = stored(kept_vectors(table, vector), "vectors")
    history = [first_codebooks(states, entries)]
    for done in range(rounds if history[0].shape[1] else 0):
        before, states = states, stored(assign(states, history, last=False), f"vector-states-{done}")
        delete_folder(table.sparkSession, before.inputFiles()[0].rpartition("/")[0])
        history.append(moved_codebooks(states, history[-1]))
    return stored(assign(states, history, last=True), "vector-codes"), history


def vector_report(table: DataFrame) -> DataFrame:
    """The contract's row for each kept vector."""
    with cleared(table.sparkSession) as keep:
        coded, history = compressed(table)
        keep(coded)
        # stored, so that its real size decides whether it is broadcast
        totals = keep(stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(history[-1])).alias("codebooks_sha256"))

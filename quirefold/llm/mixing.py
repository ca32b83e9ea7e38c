"""Mixing sources to target weights by entropy balancing.

Document rates r_i minimise sum(size_i * (r_i ln r_i - r_i)) under overlapping constraints: every source's words come to
its target exactly, and the mix keeps the corpus's shares of languages and of lengths (bands of a factor of two) as far as
a penalty on their multipliers lets it, so that the problem always has a solution. The dual is convex with one multiplier
for each source, language and band; the optimum tilts every rate exponentially, r_i = exp(sum of the multipliers of its
constraints), up to the largest rate. Newton's method runs on the dual: each iteration is one distributed aggregation
over cells (source, language, band) that yields value, gradient and Hessian, and only those numbers reach the driver.
Multipliers of sources are eliminated first, so that the system solved there is as large as languages and bands.

Rates become whole copies stratum by stratum: documents of one source and language within a few percent of one size form
a stratum; going from large to small sizes, each stratum receives the copies that bring its source nearest to the plan,
and what is left over goes to the next. Which documents get the extra copy is decided by a hash, so reruns agree: those
with the smallest hashes, exactly as many as planned. Hashes are counted by range first, so that ranks are taken inside
ranges of a few thousand documents. Rows that are equal in everything mixing reads are one row with a count meanwhile.

Null text: size 0, nothing taken. Very long texts: whole. Null source: a source of its own, last. Null language: a
language of its own. Repeated rows: each is mixed on its own and gets the same number of copies up to one. Ties of the
hash: by doc_id, then size. Null doc_id: allowed. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored, word_count

MAX_RATE = 3.0
#: Sizes within one stratum differ by less than this factor.
STRATUM_RATIO = 1.05
#: Strata in one band of lengths: a factor of two.
BAND = 14
#: How strongly a language's or band's multiplier is drawn to 0: a multiplier of m misses its share by RIDGE * m.
RIDGE = 0.01
#: Documents in one range of a stratum's hashes, about.
RANGE = 8192


def capped_shares(sizes: list[float], weights: list[float], max_rate: float = MAX_RATE) -> list[float]:
    """Shares of the whole by weight; a share stops at max_rate times its size and the excess is shared again by weight."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    free, left = set(range(len(sizes))), total
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight >= max_rate * sizes[i]}
        if not over:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = max_rate * sizes[i]
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in free or i in over)
        free -= over
    return targets


class Duals:
    """Multipliers of sources and of groups (languages, bands). A source with all it can have has an infinite one."""

    def __init__(self, sources: np.ndarray, groups: np.ndarray, max_rate: float):
        self.sources, self.groups, self.max_rate = sources, groups, max_rate

    def moved(self, by: tuple[np.ndarray, np.ndarray], share: float) -> Duals:
        return Duals(self.sources + share * by[0], self.groups + share * by[1], self.max_rate)

    def exponents(self, skey: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.sources[skey] + self.groups[first] + self.groups[second]

    def rates(self, skey: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return np.exp(np.minimum(self.exponents(skey, first, second), math.log(self.max_rate)))


def _moments(duals: Duals):
    """Cells (skey, lgroup, bgroup, tokens) -> partial sums i, j, v: the dual's value (-1, -1), its gradient (i, -1), its Hessian."""
    n, top = len(duals.sources), math.log(duals.max_rate)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            skey, first, second, tokens = (batch.column(k).to_numpy() for k in range(4))
            eta = duals.exponents(skey, first, second)
            mass = tokens * np.exp(np.minimum(eta, top))
            bent = np.where(eta < top, mass, 0.0)  # what still answers to a multiplier
            value = np.where(np.isfinite(eta), mass + np.where(eta > top, mass * (eta - top), 0.0), 0.0).sum()
            features = (skey, first + n, second + n)
            i = np.concatenate([[-1], *features, *(features[x] for x in range(3) for _ in range(3))])
            j = np.concatenate([[-1], np.full(3 * len(skey), -1), *(features[y] for _ in range(3) for y in range(3))])
            v = np.concatenate([[value], *[mass] * 3, *[bent] * 9])
            keys, at = np.unique(np.stack([i, j]), axis=1, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array(np.bincount(at.ravel(), v))], names=["i", "j", "v"])

    return scan


def newton_duals(cells: DataFrame, targets: np.ndarray, shares: np.ndarray, max_rate: float = MAX_RATE, ridge: float = RIDGE, tolerance: float = 1e-9, limit: int = 60) -> Duals:
    """cells: skey, lgroup, bgroup, tokens. targets: words of each source; shares: words of each group, met up to the ridge."""
    n, size = len(targets), float(sum(targets)) or 1.0
    held = {r["skey"]: r["tokens"] for r in cells.groupBy("skey").agg(F.sum("tokens").alias("tokens")).collect()}
    have = np.array([held.get(k, 0.0) for k in range(n)], float)
    free = (have > 0) & (targets < max_rate * have * (1 - 1e-12))
    start = np.log(np.divide(targets, have, out=np.ones(n), where=free))
    duals = Duals(np.where((have > 0) & ~free, np.inf, start), np.zeros(len(shares)), max_rate)
    if not free.any():
        return duals

    def look(at: Duals) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        rows = cells.mapInArrow(_moments(at), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        gradient, hessian = np.zeros(n + len(shares)), np.zeros((n + len(shares), len(shares) + 1))
        value = 0.0
        for i, j, v in rows:
            if i < 0:
                value = v
            elif j < 0:
                gradient[i] = v
            elif j >= n:
                hessian[i, j - n] = v
            elif i == j:
                hessian[i, -1] = v  # sources don't overlap
        value += ridge * size / 2 * float(at.groups @ at.groups) - float(at.sources[free] @ targets[free]) - float(at.groups @ shares)
        gradient[:n] = np.where(free, gradient[:n] - targets, 0.0)
        gradient[n:] += ridge * size * at.groups - shares
        return value, gradient, hessian[:n, -1], hessian[:, :-1]

    now = look(duals)
    for _ in range(limit):
        value, gradient, diagonal, rest = now
        if max(np.abs(gradient[:n][free] / targets[free]).max(), np.abs(gradient[n:]).max() / size) < tolerance:
            break
        inverse = np.where(free, 1 / np.maximum(diagonal, 1e-9 * targets + 1e-300), 0.0)
        cross, both = rest[:n], rest[n:] + ridge * size * np.eye(len(shares))
        groups = np.linalg.solve(both - cross.T @ (inverse[:, None] * cross), gradient[n:] - cross.T @ (inverse * gradient[:n]))
        step = -inverse * (gradient[:n] - cross @ groups), -groups
        share = min(1.0, 2.0 / max(1e-300, np.abs(step[0]).max(), np.abs(step[1]).max()))
        for _ in range(30):
            after = duals.moved(step, share)
            seen = look(after)
            if seen[0] <= value + 1e-12 * abs(value):
                break
            share /= 2
        duals, now = after, seen
    return duals


def _rated(duals: Duals):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(duals.rates(*keys))], names=[*batch.schema.names, "rate"])

    return scan


def _plan(key: tuple, strata: pd.DataFrame) -> pd.DataFrame:
    """Copies that each stratum of one source receives; what one stratum misses goes to the next smaller one."""
    strata = strata.sort_values(["stratum", "lgroup"], ascending=False)
    owed, low, extra = 0.0, [], []
    for n, tokens, rate, most in zip(strata["n"], strata["tokens"], strata["rate"], strata["most"], strict=True):
        owed += rate * tokens
        mean = tokens / n
        copies = int(min(most * n, max(0, math.floor(owed / mean + 0.5)))) if mean else 0
        owed -= copies * mean
        low.append(copies // n)
        extra.append(copies % n)
    return pd.DataFrame({"skey": strata["skey"], "lgroup": strata["lgroup"], "stratum": strata["stratum"], "n": strata["n"], "rate": strata["rate"], "low": low, "extra": extra})


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_rate: float = MAX_RATE, seed: int = 7, ridge: float = RIDGE) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken. Sources and languages must fit the driver; documents needn't."""
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in [c.lower() for c in docs.columns] else F.lit(None).cast("string")
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), lang.alias("lang"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("dice")), "sizes")
    sized = sized.withColumn("stratum", F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / math.log(STRATUM_RATIO))).otherwise(-1).cast("long"))
    masses = stored(sized.groupBy("source", "lang", "stratum").agg(F.sum("size").alias("tokens"), F.count("*").alias("n")), "masses")
    ordered = lambda column: sorted(((r[0], int(r[1])) for r in masses.groupBy(column).agg(F.sum("tokens")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sums, langs = ordered("source"), ordered("lang")
    bands = {r["band"]: int(r["tokens"]) for r in masses.filter("stratum >= 0").groupBy((F.col("stratum") / BAND).cast("long").alias("band")).agg(F.sum("tokens").alias("tokens")).collect()}
    targets = capped_shares([t for _, t in sums], [weights[i % len(weights)] for i in range(len(sums))], max_rate)
    table = spark.createDataFrame([(i, s, t, float(target)) for i, ((s, t), target) in enumerate(zip(sums, targets, strict=True))], "skey long, source string, source_size long, target double")
    spoken = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(langs)], "lgroup long, lang string")

    def keyed(rows: DataFrame) -> DataFrame:
        found = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["source"])).drop(table["source"])
        return found.join(F.broadcast(spoken), found["lang"].eqNullSafe(spoken["lang"])).drop(spoken["lang"])

    strata = stored(
        keyed(masses.filter("stratum >= 0")).select("skey", "lgroup", (F.lit(len(langs)) + (F.col("stratum") / BAND).cast("long")).alias("bgroup"), F.col("tokens").cast("double").alias("tokens"), "stratum", "n"), "strata"
    )
    cells = stored(strata.groupBy("skey", "lgroup", "bgroup").agg(F.sum("tokens").alias("tokens")), "cells")
    total = sum(t for _, t in sums) or 1
    shares = np.array([t for _, t in langs] + [bands.get(b, 0) for b in range(max(bands, default=-1) + 1)], float) * sum(targets) / total
    duals = newton_duals(cells, np.array(targets), shares, max_rate, ridge)
    rated = strata.mapInArrow(_rated(duals), "skey long, lgroup long, bgroup long, tokens double, stratum long, n long, rate double")
    plan = rated.withColumn("most", F.lit(int(math.floor(max_rate)))).groupBy("skey").applyInPandas(_plan, "skey long, lgroup long, stratum long, n long, rate double, low long, extra long")  # a few hundred strata for each language
    plan = stored(plan, "plan")
    drop_stored(masses, strata, cells)
    rows = keyed(sized.groupBy("doc_id", "source", "lang", "size", "stratum", "dice").agg(F.count("*").alias("equal"))).join(plan, ["skey", "lgroup", "stratum"], "left")
    share = (F.col("dice").cast("double") + 2.0**63) / 2.0**64
    ranges = F.ceil(F.coalesce("n", F.lit(1)) / RANGE)
    # nothing is taken of empty texts; their ranges only spread them
    rows = rows.withColumn("range", F.when(F.col("size") > 0, F.least(F.floor(share * ranges), ranges - 1)).otherwise(F.floor(share * 4095)))
    place = ["skey", "lgroup", "stratum"]
    counts = rows.groupBy(*place, "range").agg(F.sum("equal").alias("held"))
    earlier = Window.partitionBy(*place).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = counts.select(*place, "range", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*place, "range").orderBy("dice", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(before.hint("shuffle_hash"), [*place, "range"])
    left = F.col("extra") - F.col("before") - F.coalesce(F.sum("equal").over(inside), F.lit(0))
    rows = rows.withColumn("favoured", F.coalesce(F.least(F.greatest(left, F.lit(0)), "equal"), F.lit(0)))
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(0L, (equal - 1) div {RANGE})")))
    rows = rows.withColumn("nth", F.explode(F.expr(f"sequence(block * {RANGE} + 1, least(equal, (block + 1) * {RANGE}))")))
    chosen = F.col("nth") <= F.col("favoured")
    copies = F.when(F.col("size") > 0, F.coalesce(F.col("low"), F.lit(0)) + F.when(chosen, 1).otherwise(0)).otherwise(0).cast("long")
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))

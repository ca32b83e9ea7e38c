"""The document, artifact and operation model as relations: predicates, lineage, integrity, capacity, paging, sets.

Frames follow the stored model: documents(id, title, created_at), artifacts(id, document_id, kind, hash, mime_type, size,
created_at), operations(id, document_id, tool_id, status, created_at), operation_inputs and operation_outputs
(operation_id, artifact_id). All joins are equi-joins; Spark picks their strategy from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, MAX_PAGE, MAX_LINEAGE = 1000, 10_000, 10_000
MIME_OF_SELECTOR = {"TEXT_RANGE": ("text/plain", "text/markdown"), "PDF_REGION": ("application/pdf",), "OCR_LINE": ("application/vnd.ocr+json",)}


def by_id(frame: DataFrame, value: object, column: str = "id") -> DataFrame:
    return frame.filter(F.col(column) == F.lit(value))


def artifacts_of(artifacts: DataFrame, document_id: object) -> DataFrame:
    return artifacts.filter(F.col("document_id") == F.lit(document_id)).orderBy("created_at", "id")


def paged(frame: DataFrame, *order: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """One page of an ordered listing. The order needs a unique last column; there is no row id to fall back on."""
    if not 0 < limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"a page holds 1 to {MAX_PAGE} rows")
    return frame.orderBy(*order).offset(offset).limit(limit)


def paged_after(frame: DataFrame, *order: str, after: tuple | None = None, limit: int = PAGE) -> DataFrame:
    """The page that follows the row with these keys. A deep page costs no more than the first: nothing is skipped."""
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"a page holds 1 to {MAX_PAGE} rows")
    beyond = F.lit(False)
    for k in range(len(order) - 1, -1, -1) if after is not None else ():
        beyond = (F.col(order[k]) > F.lit(after[k])) | ((F.col(order[k]) == F.lit(after[k])) & beyond)
    return (frame if after is None else frame.filter(beyond)).orderBy(*order).limit(limit)


def tools_on(tools: DataFrame, surface: str) -> DataFrame:
    return tools.filter(F.array_contains("surfaces", surface))


def availability(tools: DataFrame, capabilities: list[str]) -> DataFrame:
    """Adds missing (capabilities that aren't there) and available."""
    there = F.array(*(F.lit(c) for c in capabilities)).cast("array<string>")
    return tools.withColumn("missing", F.array_except("capabilities", there)).withColumn("available", F.size("missing") == 0)


def selector_fits(selector: Column, mime_type: Column) -> Column:
    tests = [(selector == kind) & mime_type.isin(*types) for kind, types in MIME_OF_SELECTOR.items()]
    return F.coalesce(tests[0] | tests[1] | tests[2], F.lit(False))


def page_range(text: Column, pages: Column) -> Column:
    """struct(pages, valid) of "1-3,5": sorted and distinct; blank is valid and empty, one bad part makes all invalid."""
    parts = F.transform(F.split(text, ",", -1), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    number = lambda p, k: F.regexp_extract(p, r"^(\d+)(?:\s*-\s*(\d+))?$", k)
    bounds = F.transform(parts, lambda p: F.struct(number(p, 1).cast("bigint").alias("a"), F.coalesce(F.nullif(number(p, 2), F.lit("")), number(p, 1)).cast("bigint").alias("b")))
    shaped = F.forall(parts, lambda p: p.rlike(r"^\d{1,15}(?:\s*-\s*\d{1,15})?$"))
    inside = F.forall(bounds, lambda b: (F.least(b["a"], b["b"]) >= 1) & (F.greatest(b["a"], b["b"]) <= pages))
    blank = F.trim(text) == ""
    valid = blank | (shaped & F.when(shaped, inside).otherwise(False))
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(bounds, lambda b: F.sequence(F.least(b["a"], b["b"]), F.greatest(b["a"], b["b"]))))))
    none = F.array().cast("array<bigint>")
    return F.struct(F.when(valid & ~blank, listed).otherwise(none).alias("pages"), valid.alias("valid"))


def select_pages(pages: DataFrame, wanted: list[int], remove: bool = False) -> DataFrame:
    """Kept or removed pages of each document."""
    chosen = F.col("page").isin(wanted)
    return pages.filter(~chosen if remove else chosen)


def emptied_documents(pages: DataFrame, removed: list[int]) -> DataFrame:
    """Documents that would keep no page."""
    return pages.groupBy("doc_id").agg(F.count_if(~F.col("page").isin(removed)).alias("kept")).filter("kept = 0").select("doc_id")


def lineage(operations: DataFrame, inputs: DataFrame, outputs: DataFrame, artifacts: DataFrame, document_id: object | None = None) -> DataFrame:
    """operation_id, tool_id, input_id, output_id, created_at: one hop for every input and output of an operation."""
    ops = operations if document_id is None else operations.filter(F.col("document_id") == F.lit(document_id))
    return (
        ops.select(F.col("id").alias("operation_id"), "tool_id", "created_at")
        .join(inputs.select("operation_id", F.col("artifact_id").alias("input_id")), "operation_id")
        .join(outputs.select("operation_id", F.col("artifact_id").alias("output_id")), "operation_id")
        .join(artifacts.select(F.col("id").alias("output_id")), "output_id", "left_semi")
        .select("operation_id", "tool_id", "input_id", "output_id", "created_at")
    )


def orphan_blobs(blobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Pending blobs that no artifact refers to."""
    return blobs.join(artifacts.select("hash"), "hash", "left_anti")


def referenced_blobs(blobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    return blobs.join(artifacts.select("hash"), "hash", "left_semi")


def broken_references(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference points nowhere; must be empty."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def graph_violations(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """operation_id, problem: an operation needs 1 to 32 distinct inputs and may not output one of them."""
    side = lambda edges, i, o: edges.select("operation_id", "artifact_id", F.lit(i).alias("i"), F.lit(o).alias("o"))
    # dealt out once, by operation: an artifact's edges, then an operation's artifacts; no side is held for a join
    edges = side(inputs, 1, 0).unionByName(side(outputs, 0, 1)).repartition("operation_id")
    pairs = edges.groupBy("operation_id", "artifact_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    taken, named = F.col("i") > 0, F.col("artifact_id").isNotNull()
    met = taken & (F.col("o") > 0) & named & F.col("operation_id").isNotNull()
    counted = pairs.groupBy("operation_id").agg(F.sum("i").alias("n"), F.count_if(taken & named).alias("distinct"), F.max(met).alias("both"), F.sum("o").alias("out"))
    problem = lambda holds, text: F.when(holds, F.lit(text))
    bare = (F.col("out") > 0) & ((F.col("n") == 0) | F.col("operation_id").isNull())
    found = F.array(problem((F.col("n") > 32) | (F.col("n") != F.col("distinct")), "inputs must be 1 to 32 and distinct"), problem(F.col("both"), "an input is also an output"), problem(bare, "no input"))
    return counted.select("operation_id", F.explode(F.array_compact(found)).alias("problem"))


def capacity(artifacts: DataFrame, incoming: int, limit: int) -> DataFrame:
    """used, fits."""
    used = F.coalesce(F.sum("size"), F.lit(0))
    return artifacts.agg(used.alias("used"), (used + incoming <= limit).alias("fits"))


def single_project(projects: DataFrame) -> DataFrame:
    return projects.agg(F.count("*").alias("n")).select("n", (F.col("n") == 1).alias("fine"))


def schema_version(migrations: DataFrame) -> DataFrame:
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def integrity_audit(artifacts: DataFrame, blobs: DataFrame) -> DataFrame:
    """artifact_id, status: valid, corrupted (size or hash differ) or missing. blobs: hash, actual_size, actual_hash."""
    joined = artifacts.join(blobs, "hash", "left")
    status = F.when(F.col("actual_hash").isNull(), F.lit("missing")).when((F.col("actual_size") != F.col("size")) | (F.col("actual_hash") != F.col("hash")), F.lit("corrupted")).otherwise(F.lit("valid"))
    return joined.select(F.col("id").alias("artifact_id"), status.alias("status"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """valid, corrupted, missing, healthy."""
    count = lambda s: F.count_if(F.col("status") == s)
    return audit.agg(count("valid").alias("valid"), count("corrupted").alias("corrupted"), count("missing").alias("missing"), (F.count_if(F.col("status") != "valid") == 0).alias("healthy"))


def distinct_contents(docs: DataFrame, content: str = "text", key: str = "doc_id") -> DataFrame:
    """hash, first (smallest key), copies, size: one row for each content; only hashes are shuffled, never contents."""
    hashed = docs.select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.octet_length(content).alias("size"), F.col(key).alias("k"))
    return hashed.groupBy("hash").agg(F.min("k").alias("first"), F.count("*").alias("copies"), F.first("size").cast("long").alias("size"))


def layers(artifacts: DataFrame, overlays: DataFrame) -> DataFrame:
    """document_id, layer_id, source, kind, ordinal, visible: ordinals restart in each source."""
    a = artifacts.select("document_id", F.col("id").alias("layer_id"), F.lit("artifact").alias("source"), F.when(F.col("kind") == "ORIGINAL", F.lit("ORIGINAL")).otherwise(F.lit("DERIVED")).alias("kind"), "created_at")
    o = overlays.select("document_id", F.col("id").alias("layer_id"), F.lit("overlay").alias("source"), F.lit("OVERLAY").alias("kind"), "created_at")
    order = Window.partitionBy("document_id", "source").orderBy("created_at", "layer_id")
    return a.unionByName(o).withColumn("ordinal", F.row_number().over(order) - 1).withColumn("visible", F.lit(True)).drop("created_at")


def toggle_layer(rows: DataFrame, layer_id: object) -> DataFrame:
    return rows.withColumn("visible", F.when(F.col("layer_id") == F.lit(layer_id), ~F.col("visible")).otherwise(F.col("visible")))


def merged_pages(*documents: DataFrame) -> DataFrame:
    """Pages of several documents one after another: part, page, text, position. Pages are ranked inside their part only."""
    out = None
    for part, pages in enumerate(documents):
        rows = pages.select(F.lit(part).alias("part"), "page", "text")
        out = rows if out is None else out.unionByName(rows)
    sizes = out.groupBy("part").agg(F.count("*").alias("size"))  # a row for each document given
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("page"))
    return out.withColumn("rank", rank).join(offsets, "part").select("part", "page", "text", (F.col("offset") + F.col("rank")).cast("int").alias("position"))


def organized_pages(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Pages in the plan's order with their rotation. plan: doc_id, page, position, rotation, and turn for the document."""
    joined = pages.join(plan, ["doc_id", "page"])
    turned = F.pmod(F.coalesce(F.col("current_rotation"), F.lit(0)) + F.coalesce("turn", F.lit(0)) + F.coalesce("rotation", F.lit(0)), F.lit(360))
    return joined.select("doc_id", "position", "page", turned.alias("rotation"))


def margins_fit(top: Column, right: Column, bottom: Column, left: Column) -> Column:
    """Crop margins in percent: none negative, and less than 95 together on each axis."""
    return (top >= 0) & (right >= 0) & (bottom >= 0) & (left >= 0) & (top + bottom < 95) & (left + right < 95)


def form_pages(widgets: DataFrame) -> DataFrame:
    """field, pages: distinct and sorted."""
    return widgets.groupBy("field").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def top_rows(frame: DataFrame, *order: str, n: int = 15) -> DataFrame:
    """The first n rows as a preview."""
    return frame.orderBy(*order).limit(n)


def command_history(commands: DataFrame, most: int = 50) -> DataFrame:
    """doc_id, seq, state: the edit that shows after each command (edit, undo, redo); at most `most` steps can be undone."""
    import pandas as pd

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        done: list[int] = []
        undone: list[int] = []
        rows = []
        for seq, kind in frame.sort_values("seq")[["seq", "kind"]].itertuples(index=False):
            if kind == "edit":
                done, undone = [*done, seq][-most:], []
            elif kind == "undo" and done:
                undone.append(done.pop())
            elif kind == "redo" and undone:
                done.append(undone.pop())
            rows.append((frame["doc_id"].iloc[0], seq, done[-1] if done else None))
        return pd.DataFrame(rows, columns=["doc_id", "seq", "state"]).astype({"state": "Int64"})

    return commands.groupBy("doc_id").applyInPandas(fold, "doc_id long, seq long, state long")


def batch_totals(files: DataFrame, most_files: int = 50, most_bytes: int = 512 << 20) -> DataFrame:
    """batch_id, files, bytes, exceeds: whether a batch has too many files or bytes."""
    total = F.coalesce(F.sum("size"), F.lit(0))
    return files.groupBy("batch_id").agg(F.count("*").alias("files"), total.alias("bytes"), ((F.count("*") > most_files) | (total > most_bytes)).alias("exceeds"))


def result_totals(items: DataFrame) -> DataFrame:
    """before, after, saved, percent over all items."""
    from ..functions.numbers import saved_percent

    sums = items.agg(F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"))
    return sums.select("before", "after", (F.col("before") - F.col("after")).alias("saved"), saved_percent(F.col("before"), F.col("after")).alias("percent"))

"""JSON-Lines requests and responses: each line names a method; unknown or broken ones get an error line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import extract_information
from ..operators.segments import line_segments

REQUEST = "id string, method string, params struct<text: string, mode: string>"
MAX_LINE = 8 << 20
METHODS = ("extract", "segment")


def parse_requests(lines: DataFrame) -> DataFrame:
    """line_no, id, method, text, mode, error from line_no and value."""
    parsed = lines.withColumn("r", F.from_json("value", REQUEST))
    error = F.when(F.octet_length("value") > MAX_LINE, F.lit("line too long")).when(F.col("r.id").isNull() | F.col("r.method").isNull(), F.lit("invalid request")).when(~F.col("r.method").isin(*METHODS), F.lit("unknown method")).when(F.coalesce(F.col("r.params.text"), F.lit("")) == "", F.lit("text is missing"))
    return parsed.select("line_no", "r.id", "r.method", F.col("r.params.text").alias("text"), F.coalesce("r.params.mode", F.lit("all")).alias("mode"), error.alias("error"))


def respond(lines: DataFrame) -> DataFrame:
    """line_no, value: a JSON response for each request line."""
    requests = parse_requests(lines)
    docs = lambda method: requests.filter(F.col("error").isNull() & (F.col("method") == method)).select(F.col("line_no").alias("doc_id"), "text")
    extracted = extract_information(docs("extract")).select(F.col("doc_id").alias("line_no"), F.to_json(F.struct("metrics", "language", "entities", "key_values", "tables", "sections")).alias("result"))
    segmented = line_segments(docs("segment")).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "segment"))), lambda s: s["segment"]).alias("segments")).select(F.col("doc_id").alias("line_no"), F.to_json(F.struct("segments")).alias("result"))
    joined = requests.join(extracted.unionByName(segmented), "line_no", "left")
    body = F.when(F.col("error").isNotNull(), F.to_json(F.struct("id", "error"))).otherwise(F.concat(F.lit('{"id":'), F.to_json(F.struct("id")).substr(7, 1 << 20).substr(F.lit(1), F.length(F.to_json(F.struct("id"))) - 7), F.lit(',"result":'), F.col("result"), F.lit("}")))
    return joined.select("line_no", body.alias("value"))

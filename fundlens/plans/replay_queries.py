"""Registered queries that replay tables through the streaming jobs, with the SQL of their batch meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..session import Staging
from ..sources.artifacts import FolderStore, create_artifacts
from ..streaming import attribution as AT, jobs as J
from . import app_queries, app_tables as A, statement_tables as tables
from .app_tables import read
from .statement_oracle import chained
from .statement_queries import register

SLICES = 4


def folder(spark: SparkSession) -> str:
    root = Staging(spark).folder
    if root is None:
        raise ValueError("streaming jobs need a shared folder: set spark.checkpoint.dir")
    return f"{root}-replay"


def slices(rows: DataFrame, time: str, parts: int = SLICES) -> list[DataFrame]:
    """The rows cut into slices of time, in the order of time."""
    moment = F.unix_micros(F.col(time).cast("timestamp"))
    ends = rows.agg(F.min(moment).alias("a"), F.max(moment).alias("b")).first()
    if ends.a is None:
        return []
    width = (ends.b - ends.a) // parts + 1
    return [rows.filter(F.floor((moment - ends.a) / width) == i) for i in range(parts)]


def replay(parts: list[DataFrame], kind: StructType, path: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Brings one part after the other to a stream that ``start`` runs until nothing is left. A part is one micro-batch
    of as many files as it has partitions: what has arrived by then is taken whole."""
    for part in parts:
        part.write.mode("append").parquet(path)
        start(part.sparkSession.readStream.schema(kind).parquet(path)).awaitTermination()


@register(
    "stream_unique_events", "user_id:n event_type:s event_id:n",
    "SELECT user_id, event_type, arg_min(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type",
)
def _(spark, sf_dir):
    at = folder(spark)
    events = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    job = J.UniqueJob(spark, at, "user_id bigint, event_type string, ts timestamp, event_id bigint", ["user_id", "event_type"], "ts", "1 hour", 16)
    replay(slices(events, "ts"), events.schema, f"{at}/in", lambda stream: J.run_batches(job.near(stream), job, f"{at}/checkpoint"))
    return job.accepted.read()



@register("stream_attribution", "visitor_id:n visit_id:n origin:s app:s utm_source:s utm_medium:s utm_campaign:s utm_term:s", app_queries.ATTRIBUTION)
def _(spark, sf_dir):
    at = folder(spark)
    visits = A.visits(spark, sf_dir).select("visitor_id", "visit_id", F.col("ts").cast("timestamp").alias("ts"), "url")
    # A visit of nobody long after all others lets the watermark pass them.
    last = visits.agg(F.max("ts").alias("ts"))
    nobody = [
        last.select(F.lit(-1).cast("bigint").alias("visitor_id"), F.lit(-1).cast("bigint").alias("visit_id"), F.expr(f"ts + interval {days} days").alias("ts"), F.lit("").alias("url")).filter(
            "ts is not null") for days in (100, 200)]
    AT.use_rocksdb(spark)

    def start(stream):
        resolved = AT.attribution_stream(stream, "1 hour").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        return resolved.trigger(availableNow=True).start()

    # The next part's batch resolves what the watermark has passed; without batches of their own for that, half as many run.
    own_batches = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        replay([*slices(visits, "ts"), *nobody], visits.schema, f"{at}/in", start)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", own_batches)
    return spark.read.schema(J.schema(AT.OUTPUT)).parquet(f"{at}/out").filter("visitor_id >= 0")


@register(
    "stream_ledger", "document_id:s attempt_count:n extraction_provider:s ingestion_status:s rejected:b",
    f"""SELECT document_id, 1 AS attempt_count, 'openai' AS extraction_provider, 'PENDING' AS ingestion_status, false AS rejected FROM ({A.FANNED}) WHERE error_code IS NULL
      UNION ALL SELECT DISTINCT entry_id || ' ' || error_code, 0, NULL, NULL, true FROM ({A.FANNED}) WHERE error_code IS NOT NULL""",
)
def _(spark, sf_dir):
    at = folder(spark)
    job = J.LedgerJob(spark, at, buckets=32)
    rows = A.order_submissions(spark, sf_dir).select("entry_id", "submitted_at", "bank_statement_gcs_keys")
    replay(slices(rows, "submitted_at"), rows.schema, f"{at}/in", lambda stream: J.run_batches(stream, job, f"{at}/checkpoint"))
    job(rows, SLICES + 1)  # all requests once more: nothing changes
    kept = job.current().select("document_id", "attempt_count", "extraction_provider", "ingestion_status", F.lit(False).alias("rejected"))
    refused = job.rejected.read().select(F.concat_ws(" ", "entry_id", "error_code").alias("document_id")).distinct()
    none = [F.lit(None).cast("string").alias(c) for c in ("extraction_provider", "ingestion_status")]
    return kept.unionByName(refused.select("document_id", F.lit(0).cast("bigint").alias("attempt_count"), *none, F.lit(True).alias("rejected")))


@register(
    "stream_readiness", "entry_id:s event_key:s status:s expected_document_count:n",
    chained("""SELECT entry_id, 'bank_statement_underwriting:' || entry_id || ':v1' AS event_key, CASE WHEN review THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS status,
      expected AS expected_document_count FROM sub WHERE whole"""),
)
def _(spark, sf_dir):
    at = folder(spark)
    ledger = tables.ledger(spark, sf_dir)
    job = J.ReadinessJob(spark, at, lambda: ledger, buckets=16)
    extractions = tables.extractions(spark, sf_dir)
    whole = F.to_json(F.struct(*extractions.columns), {"ignoreNullFields": "false"})
    half = F.pmod(F.xxhash64("file_id"), F.lit(2))
    for run in (0, 1):
        job(extractions.filter(half == run).select(whole.alias("value")), run)
    return job.emitted.read()


@register(
    "created_artifacts", "object_name:s run:n decision:s actual_sha256:s",
    """SELECT 'apps/' || source || '/' || doc_id || '.pdf' AS object_name, run,
         CASE WHEN run = 1 THEN 'create' WHEN doc_id % 3 = 0 THEN 'FINAL_ARTIFACT_MISMATCH' ELSE 'reuse' END AS decision, sha256(coalesce(text, '')) AS actual_sha256
       FROM documents, (SELECT unnest([1, 2]) AS run)""",
)
def _(spark, sf_dir):
    # Two runs over all documents; in the second every third is of another summary, the others are rendered anew.
    stage, store = Staging(spark), FolderStore(f"{folder(spark)}/store")
    documents = read(spark, sf_dir, "documents").select(
        F.expr("concat('apps/', source, '/', doc_id, '.pdf')").alias("object_name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"),
        F.col("doc_id").cast("string").alias("entry_id"), F.sha2("source", 256).alias("fingerprint"), F.lit("1").alias("source_generation"), F.sha2("source", 256).alias("source_sha256"))
    first = stage(create_artifacts(documents, store), "first")
    number = F.col("entry_id").cast("bigint")
    again = documents.withColumn("fingerprint", F.when(number % 3 == 0, F.sha2("entry_id", 256)).otherwise(F.col("fingerprint"))).withColumn(
        "content", F.concat("content", F.lit(" again").cast("binary")))
    second = stage(create_artifacts(again, store), "second")
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))

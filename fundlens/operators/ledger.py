"""The document ledger: fan-out, upsert, state transitions and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys as K
from ..functions import text as T
from ..functions import urls as L

PROVIDERS = ["openai", "llama"]
# Fixed value: URIs that count as PDF documents.
PDF_URI = r"(?is)\.pdf(?:[?#].*)?$"


def fan_out_documents(submissions: DataFrame) -> DataFrame:
    """One row per PDF of each submission, or one error row for a bad submission.

    Positions keep their gaps. A repeated or malformed URI rejects the whole
    submission, as a partial set must not reach the ledger. Everything is decided
    inside the row's own array, so nothing is shuffled.
    """
    listed = F.filter(
        F.transform(F.coalesce("bank_statement_gcs_keys", F.array().cast("array<string>")), lambda u, i: F.struct(u.alias("uri"), (i + 1).alias("index"))),
        lambda d: d["uri"].isNotNull() & d["uri"].rlike(PDF_URI),
    )
    uris = F.transform(F.col("documents"), lambda d: d["uri"])
    invalid = F.exists(uris, lambda u: ~u.rlike(r"^gs://[^/]+/.+$"))
    error = (
        F.when(T.blank(F.col("entry_id")) | F.col("submitted_at").isNull(), "INVALID_SUBMISSION_ROW")
        .when(F.size(F.array_distinct(uris)) < F.size(uris), "DUPLICATE_GCS_URI")
        .when(invalid, "INVALID_GCS_URI")
    )
    checked = submissions.select("entry_id", "submitted_at", listed.alias("documents")).withColumn("error_code", error)
    items = F.when(F.col("error_code").isNull(), F.col("documents")).otherwise(
        F.array(F.lit(None).cast("struct<uri: string, index: int>"))
    )
    rows = checked.select("entry_id", "submitted_at", "error_code", F.explode(items).alias("d"))
    return rows.select(
        F.when(F.col("error_code").isNull(), K.document_id(F.col("entry_id"), F.col("d.uri"))).alias("document_id"),
        "entry_id", "submitted_at",
        F.when(F.col("error_code").isNull(), "bank_statement").alias("document_type"),
        F.col("d.index").cast("bigint").alias("document_index"),
        F.col("d.uri").alias("gcs_uri"), "error_code",
    )


def recent_submission(submissions: DataFrame, now: Column, days: int | None = 30) -> DataFrame:
    """Latest submission row of each entry, optionally within a number of days; ties go by the row's JSON text."""
    kept = submissions if days is None else submissions.filter(F.col("submitted_at") >= now - F.expr(f"interval {days} days"))
    others = [c for c in submissions.columns if c != "entry_id"]
    return kept.groupBy("entry_id").agg(F.max_by(F.struct(*others), F.struct("submitted_at", F.to_json(F.struct(*others)))).alias("r")).select("entry_id", "r.*")


def upsert_documents(ledger: DataFrame, updates: DataFrame, provider: str, event_id: Column, at: Column) -> DataFrame:
    """Ledger after an ingestion request for the given documents.

    Unknown documents are inserted as pending; known ones without a provider get
    it and one more attempt; the rest stay as they are, so a replay is harmless.
    """
    key = ["document_id", "submitted_at"]
    requested = updates.select(*key, *[F.col(c).alias(f"new_{c}") for c in ("entry_id", "document_type", "document_index", "gcs_uri")]).dropDuplicates(key)
    both = ledger.withColumn("_old", F.lit(True)).join(requested.withColumn("_new", F.lit(True)), key, "full_outer")
    inserted = F.col("_old").isNull()
    retried = F.col("_old").isNotNull() & F.col("_new").isNotNull() & F.col("extraction_provider").isNull()
    touched = inserted | retried
    changes = {
        "entry_id": F.coalesce("entry_id", "new_entry_id"),
        "document_type": F.coalesce("document_type", "new_document_type"),
        "document_index": F.coalesce("document_index", "new_document_index"),
        "gcs_uri": F.coalesce("gcs_uri", "new_gcs_uri"),
        "ingestion_status": F.when(inserted, "PENDING").otherwise(F.col("ingestion_status")),
        "attempt_count": F.when(inserted, F.lit(1)).when(retried, F.col("attempt_count") + 1).otherwise(F.col("attempt_count")),
        "source_event_id": F.when(touched, event_id).otherwise(F.col("source_event_id")),
        "extraction_provider": F.when(touched, provider).otherwise(F.col("extraction_provider")),
        "provider_status": F.when(touched, F.coalesce("provider_status", F.lit("PENDING"))).otherwise(F.col("provider_status")),
        "created_at": F.when(inserted, at).otherwise(F.col("created_at")),
        "updated_at": F.when(touched, at).otherwise(F.col("updated_at")),
    }
    return both.select(*[changes.get(c, F.col(c)).alias(c) for c in ledger.columns])


# The columns each transition sets, and the status it leaves.
TRANSITIONS = {
    "uploaded": "UPLOADED",
    "attached": "PROCESSING",
    "completed": "COMPLETED",
    "failed": "FAILED",
}
UPLOAD_COLUMNS = ["gcs_generation", "source_content_type", "source_size_bytes", "source_sha256", "file_id"]


def apply_transitions(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Ledger after all transitions (document_id, submitted_at, at, event_id, transition, values).

    A transition belongs to one submission of a document; events without ``submitted_at``
    come from a ledger that has one row per document.
    Each column takes its latest setting; the latest transition decides the
    status. All settings of a document are folded in one map-side aggregation.
    """
    moment = F.struct("at", "event_id")
    kind = F.col("transition")
    known = events.filter(kind.isin(list(TRANSITIONS)))

    def latest(value, condition):
        return F.max_by(value, F.when(condition, moment))

    uploaded, failed = kind == "uploaded", kind == "failed"
    status = F.create_map(*[F.lit(x) for pair in TRANSITIONS.items() for x in pair])
    with_store = kind.isin("attached", "completed")
    keys = [c for c in ("document_id", "submitted_at") if c in events.columns]
    folded = known.groupBy(*keys).agg(
        F.max_by(status[kind], moment).alias("_status"),
        *[latest(F.col(c), uploaded).alias(f"_{c}") for c in UPLOAD_COLUMNS],
        F.bool_or(uploaded).alias("_has_upload"),
        latest(F.col("vector_store_file_id"), with_store).alias("_vector_store_file_id"),
        latest(F.when(uploaded, F.lit("uploaded")).otherwise(F.col("openai_status")), ~failed).alias("_openai_status"),
        F.max_by(F.when(failed, T.stable_error_code(F.col("error_code"))), moment).alias("_error_code"),
        F.max(F.when(kind == "completed", F.col("at"))).alias("_completed_at"),
        F.max("at").alias("_at"),
    )
    joined = ledger.join(folded, keys, "left")
    moved = F.col("_status").isNotNull()

    def keep(name):
        return F.when(moved, F.col(f"_{name}")).otherwise(F.col(name))

    changes = {c: F.when(F.col("_has_upload"), F.col(f"_{c}")).otherwise(F.col(c)) for c in UPLOAD_COLUMNS}
    changes |= {
        "provider_file_id": F.when(F.col("_has_upload"), F.col("_file_id")).otherwise(F.col("provider_file_id")),
        "vector_store_file_id": F.coalesce("_vector_store_file_id", "vector_store_file_id"),
        "openai_status": F.coalesce("_openai_status", "openai_status"),
        "ingestion_status": F.coalesce("_status", "ingestion_status"),
        "error_code": keep("error_code"),
        "completed_at": F.coalesce("_completed_at", "completed_at"),
        "updated_at": F.greatest("updated_at", "_at"),
    }
    return joined.select(*[changes.get(c, F.col(c)).alias(c) for c in ledger.columns])


def next_step(status: Column, file_id: Column, store_file_id: Column) -> Column:
    """Where an interrupted ingestion resumes."""
    return (
        F.when(status == "COMPLETED", "skip")
        .when(file_id.isNull(), "upload")
        .when(store_file_id.isNull(), "attach")
        .otherwise("poll")
    )


def provider_lock_error(configured: Column, stored: Column) -> Column:
    locked = T.clean(stored)
    return F.when(~configured.isin(PROVIDERS), "EXTRACTION_PROVIDER_INVALID").when(
        locked.isNotNull() & (locked != configured), "EXTRACTION_PROVIDER_RUNTIME_MISMATCH"
    )


def new_artifacts(candidates: DataFrame, existing: DataFrame, key: str = "object_name") -> DataFrame:
    """Artifacts to create: those whose object name is not taken yet."""
    return candidates.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


ARTIFACT_TYPE = "underwritten-v1"


def final_object_name(source_object: Column, entry_id: Column, fingerprint: Column) -> Column:
    return F.concat(
        L.folder(source_object), F.lit("/"), entry_id, F.lit("_underwritten_v1_"), fingerprint, F.lit(".pdf")
    )


def verify_artifacts(expected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Decision per expected artifact: create, reuse or an error code.

    ``artifacts`` has object_name, generation, content and recorded metadata. An
    event's ``expected_generation`` and ``expected_sha256`` are checked if given.
    """
    digests = artifacts.select(
        "object_name", "generation", F.sha2("content", 256).alias("actual_sha256"),
        *[F.col(c).alias(f"recorded_{c}") for c in ("artifact_type", "entry_id", "fingerprint", "source_generation", "source_sha256", "final_sha256")],
    )
    same = (F.col("recorded_artifact_type") == ARTIFACT_TYPE) & (F.col("recorded_final_sha256") == F.col("actual_sha256"))
    for name in ("entry_id", "fingerprint", "source_generation", "source_sha256"):
        same = same & (F.col(f"recorded_{name}") == F.col(name))
    if "expected_generation" in expected.columns:
        same = same & (F.col("generation") == F.col("expected_generation"))
    if "expected_sha256" in expected.columns:
        same = same & (F.col("actual_sha256") == F.lower("expected_sha256"))
    decision = (
        F.when(F.col("actual_sha256").isNull(), "create")
        .when(~F.coalesce(F.col("generation").rlike("^[0-9]+$"), F.lit(False)), "FINAL_GENERATION_INVALID")
        .when(F.coalesce(same, F.lit(False)), "reuse")
        .otherwise("FINAL_ARTIFACT_MISMATCH")
    )
    return expected.join(digests, "object_name", "left").select(*expected.columns, "actual_sha256", decision.alias("decision"))


def verify_sources(submissions: DataFrame, objects: DataFrame, layout_version: str = "underwriting-v1") -> DataFrame:
    """Error code per submission's source document; NULL when it may be used.

    ``objects`` has uri, generation, content_type and content. Generation and
    digest must equal the recorded ones where the layout is versioned.
    """
    stored = objects.select(
        F.col("uri").alias("pdf_gcs_key"), F.col("generation").alias("_generation"), F.sha2("content", 256).alias("_sha256"),
        (
            (F.col("content_type") == "application/pdf") & (F.decode(F.substring("content", 1, 5), "ISO-8859-1") == "%PDF-")
            & F.col("generation").rlike("^[0-9]+$")
        ).alias("_usable"),
    )
    versioned = F.coalesce(F.col("pdf_layout_version") == layout_version, F.lit(False))
    recorded = F.lower("pdf_source_sha256")
    intact = (F.col("_generation") == F.col("pdf_source_generation")) & recorded.rlike("^[a-f0-9]{64}$") & (F.col("_sha256") == recorded)
    code = (
        F.when(~F.coalesce(F.col("pdf_gcs_key").rlike("^gs://[^/]+/.+$"), F.lit(False)), "GCS_URI_INVALID")
        .when(versioned & ~F.coalesce(F.col("pdf_source_generation").rlike("^[0-9]+$"), F.lit(False)), "SOURCE_GENERATION_INVALID")
        .when(~F.coalesce("_usable", F.lit(False)), "SOURCE_PDF_INVALID")
        .when(versioned & ~F.coalesce(intact, F.lit(False)), "SOURCE_INTEGRITY_MISMATCH")
    )
    return submissions.join(stored, "pdf_gcs_key", "left").select("entry_id", "pdf_gcs_key", code.alias("error_code"))


def scan_source_documents(spark, path: str, pattern: str = "*") -> DataFrame:
    """Stored source files with size, digest and whether a PDF header starts
    within the first 1,024 bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    head = F.decode(F.substring("content", 1, 1024 + 5), "ISO-8859-1")
    return files.select(
        "path", F.col("modificationTime").alias("modified_at"),
        F.col("length").alias("source_size_bytes"),
        F.sha2("content", 256).alias("source_sha256"),
        (F.instr(head, "%PDF-") > 0).alias("valid_pdf_header"),
        F.lit("application/pdf").alias("source_content_type"),
    )


def chunk_documents(documents: DataFrame, key: str, text: str, size: int = 800, overlap: int = 400) -> DataFrame:
    """Sliding chunks of whitespace tokens over each whole text, last chunk short."""
    step = size - overlap
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    counted = (
        documents.select(key, trimmed.alias("trimmed")).filter("trimmed <> ''")
        .select(key, F.split("trimmed", r"\s+").alias("tokens")).withColumn("n", F.size("tokens"))
    )
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - overlap - 1, F.lit(0)), F.lit(step))
    # Sliced before exploding, so a long text is not copied once per chunk.
    chunks = F.transform(starts, lambda start: F.slice("tokens", start + 1, size))
    return counted.select(key, F.posexplode(chunks).alias("chunk_index", "words")).select(
        key, F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.size("words").alias("token_count"), F.array_join("words", " ").alias("chunk"),
    )

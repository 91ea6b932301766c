"""Readiness events: emission, validation and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import keys as K
from ..schemas import PDF_READY_EVENT, READY_EVENT

# Message types, key sets and patterns of the event contracts.
READY_TYPE = "bank_statement_underwriting_ready"
PDF_READY_TYPE = "application_pdf_ready"
STATUSES = ["READY", "REVIEW_REQUIRED"]
READY_KEYS = [
    "event_type", "schema_version", "analysis_version", "event_key", "entry_id", "status",
    "expected_document_count", "extracted_document_count",
]
PDF_READY_KEYS = [
    "event_type", "schema_version", "analysis_version", "event_key", "entry_id", "status",
    "summary_fingerprint", "source_generation", "final_generation", "final_pdf_sha256",
]
ENTRY_ID = r"^[A-Za-z0-9_-]{1,128}\z"
OPAQUE_ID = r"^[A-Za-z0-9_-]{1,256}\z"
SHA256 = r"^[a-f0-9]{64}\z"
DIGITS = r"^[0-9]+\z"
DECIMAL = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"
LAYOUT_VERSION = "underwriting-v1"


def readiness_events(summary: DataFrame, emitted: DataFrame | None = None) -> DataFrame:
    """One event per submission whose documents are all processed, not yet emitted."""
    done = summary.filter("all_documents_processed").select(
        F.lit(READY_TYPE).alias("event_type"),
        F.lit(1).cast("bigint").alias("schema_version"),
        "analysis_version",
        K.ready_event_key(F.col("entry_id")).alias("event_key"),
        "entry_id",
        F.col("analysis_status").alias("status"),
        "expected_document_count",
        "extracted_document_count",
    )
    return done if emitted is None else done.join(emitted.select("event_key"), "event_key", "left_anti").select(*done.columns)


def event_messages(events: DataFrame, key: str = "event_key", attributes: list[str] = ["event_type", "schema_version"]) -> DataFrame:
    """Key, JSON body and attributes (texts by name; those that are null are left out), for a message sink."""
    pairs = F.filter(F.array(*[F.struct(F.lit(a).alias("name"), F.col(a).cast("string").alias("text")) for a in attributes]), lambda p: p["text"].isNotNull())
    return events.select(F.col(key).alias("key"), F.to_json(F.struct(*events.columns)).alias("value"), F.map_from_entries(pairs).alias("attributes"))


def submission_messages(submissions: DataFrame) -> DataFrame:
    """What is sent when a submission is stored: its entry, folder and layout, with the entry as an attribute."""
    return event_messages(submissions.select("entry_id", "gcs_folder", "pdf_layout_version"), "entry_id", ["entry_id"])


def _no_other_keys(keys: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0


def _parsed(messages: DataFrame, schema: str) -> DataFrame:
    """Adds ``_json`` (a variant; NULL for what is no JSON), ``_keys`` (NULL for what is no object) and the event ``e``.

    The typed reader takes nearly all there is to read. It gives no number for a whole one with a fraction of zeros,
    and writes that fraction into texts; such fields, and they alone, are looked up in the variant.
    """
    value, e = F.col("value"), F.col("e")
    parsed = messages.withColumn("_json", F.try_parse_json(value)).withColumn("_keys", F.json_object_keys(value)).withColumn("e", F.from_json(value, schema))
    fields = []
    for field in StructType.fromDDL(schema).fields:
        read = e[field.name]
        if field.dataType.typeName() == "long":
            read = F.coalesce(read, _whole(field.name))
        elif field.name.endswith("generation"):
            read = F.when(F.contains(read, F.lit(".")), F.coalesce(_whole(field.name).cast("string"), read)).otherwise(read)
        fields.append(read.alias(field.name))
    return parsed.withColumn("e", F.when(e.isNotNull(), F.struct(*fields)))


def _kind(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("_json", f"$.{name}", "variant"))


def _whole(name: str) -> Column:
    """A whole number of a message, also when it is written with a fraction of zeros; NULL for anything else."""
    exact = F.try_variant_get("_json", f"$.{name}", "decimal(38,9)")
    return F.when(_kind(name).rlike("^(BIGINT|DECIMAL|DOUBLE)") & (exact == F.floor(exact)), exact.cast("bigint"))


def validate_ready_events(messages: DataFrame) -> DataFrame:
    """Adds route (accepted, irrelevant, invalid), code and the parsed event ``e``."""
    parsed, e = _parsed(messages, READY_EVENT), F.col("e")
    contract = (
        _no_other_keys(F.col("_keys"), READY_KEYS)
        & e["entry_id"].rlike(ENTRY_ID)
        & (e["event_key"] == K.ready_event_key(e["entry_id"]))
        & e["status"].isin(STATUSES)
        & (e["expected_document_count"] >= 1)
        & (e["extracted_document_count"] == e["expected_document_count"])
    )
    relevant = (e["event_type"] == READY_TYPE) & (e["schema_version"] == 1) & (e["analysis_version"] == 1)
    code = (
        F.when(F.col("_json").isNull(), "EVENT_JSON_INVALID")
        .when(F.col("_keys").isNull(), "EVENT_SHAPE_INVALID")
        .when(~F.coalesce(relevant, F.lit(False)), F.lit(None).cast("string"))
        .when(~F.coalesce(contract, F.lit(False)), "EVENT_CONTRACT_INVALID")
    )
    route = F.when(F.col("code").isNotNull(), "invalid").when(F.coalesce(relevant, F.lit(False)), "accepted").otherwise("irrelevant")
    return parsed.withColumn("code", code).withColumn("route", route).drop("_json", "_keys")


def pdf_ready_contract(event: Column, keys: Column) -> Column:
    fingerprint = F.lower(event["summary_fingerprint"])
    valid = (
        (F.size(keys) == len(PDF_READY_KEYS)) & _no_other_keys(keys, PDF_READY_KEYS)
        & (event["event_type"] == PDF_READY_TYPE)
        & (event["schema_version"] == 1) & (event["analysis_version"] == 1)
        & event["entry_id"].rlike(ENTRY_ID)
        & (event["event_key"] == K.pdf_event_key(event["entry_id"], fingerprint))
        & event["status"].isin(STATUSES)
        & fingerprint.rlike(SHA256)
        & event["source_generation"].rlike(DIGITS) & event["final_generation"].rlike(DIGITS)
        & F.lower(event["final_pdf_sha256"]).rlike(SHA256)
    )
    return F.coalesce(valid, F.lit(False))


def _with_pdf_event(messages: DataFrame) -> DataFrame:
    parsed = _parsed(messages, PDF_READY_EVENT)
    lowered = F.col("e").withField("summary_fingerprint", F.lower("e.summary_fingerprint")).withField(
        "final_pdf_sha256", F.lower("e.final_pdf_sha256")
    )
    return parsed.withColumn("is_valid", pdf_ready_contract(F.col("e"), F.col("_keys"))).withColumn("e", lowered)


def validate_pdf_ready_events(messages: DataFrame) -> DataFrame:
    """Adds validity and the event ``e`` with its digests in lower case."""
    return _with_pdf_event(messages).withColumn("code", F.when(~F.col("is_valid"), "READY_EVENT_INVALID")).drop("_json", "_keys")


def delivery_decision(messages: DataFrame, submissions: DataFrame) -> DataFrame:
    """What to do with each delivery message: send, acknowledge, drop or retry.

    A message whose submission is not visible yet is retried; the finished
    document alone never causes a second notification. Of several submissions of an
    entry the latest counts (``submitted_at``, if there is one, then the layout). An event
    type that is null, empty, false or zero is none; an entry id has to be a text.
    """
    checked = _with_pdf_event(messages)
    said, entry = F.col("e.event_type"), F.col("e.entry_id")
    # What reads like a number or a truth value may be a text all the same; only such a message is asked for its kind.
    zero = F.when(said.rlike(r"^-?0*(\.0*)?([eE].*)?\z") | (said == "false"), (said == "") | (_kind("event_type") != "STRING")).otherwise(said.isNull())
    ready = F.coalesce(said == PDF_READY_TYPE, F.lit(False))
    entry = F.when(~entry.rlike(r"^(-?[0-9].*|true|false)\z") | (_kind("entry_id") == "STRING"), entry)
    order = F.struct(*[c for c in ("submitted_at", "pdf_layout_version") if c in submissions.columns])
    latest = submissions.groupBy(F.col("entry_id").alias("_entry")).agg(F.max_by("pdf_layout_version", order).alias("pdf_layout_version"))
    known = latest.withColumn("_seen", F.lit(True))
    read = checked.select(
        *messages.columns, "is_valid", F.col("_json").isNotNull().alias("_is_json"), (~zero).alias("_typed"), ready.alias("_ready"), entry.alias("entry_id"))
    joined = read.join(known, F.col("entry_id") == F.col("_entry"), "left")
    action = (
        F.when(~F.col("_is_json"), "drop:PAYLOAD_JSON_INVALID")
        .when(F.col("_typed") & ~F.col("_ready"), "drop:EVENT_TYPE_IRRELEVANT")
        .when(F.col("_ready") & ~F.col("is_valid"), "drop:READY_EVENT_INVALID")
        .when(~F.coalesce(F.col("entry_id").rlike(ENTRY_ID), F.lit(False)), "drop:ENTRY_ID_INVALID")
        .when(F.col("_seen").isNull(), "retry:SUBMISSION_NOT_VISIBLE")
        .when(F.col("_ready"), "ack:FINALIZED")
        .when(F.col("pdf_layout_version").isNotNull() & (F.col("pdf_layout_version") != LAYOUT_VERSION), "retry:PDF_LAYOUT_VERSION_UNSUPPORTED")
        .otherwise("send")
    )
    return joined.select(*messages.columns, "entry_id", action.alias("action"))


STATEMENT_FIELDS = {
    "deposits": "decimal", "deposit_count": "count", "true_revenue": "decimal", "withdrawals": "decimal",
    "negative_ending_days": "count", "average_daily_balance": "decimal",
}
STATEMENT_TEXTS = {
    "account_last_four": 4, "statement_start_date": 10, "statement_end_date": 10,
    "mca_detected": 16, "quality_status": 32,
}


def validate_summaries(summaries: DataFrame, statements: DataFrame, events: DataFrame) -> DataFrame:
    """Error codes of each event's summary; an empty list means it may be used.

    Statements are checked as rows and folded per entry with sums and flags, so
    no list of statements is built, however many an entry has.
    """
    ready = F.col("_status") == "READY"
    wrong = F.lit(False)
    for name, kind in STATEMENT_FIELDS.items():
        text = F.col(name).cast("string")
        shaped = text.rlike(DECIMAL) if kind == "decimal" else text.rlike(r"^(?:0|[1-9][0-9]*)\z")
        wrong = wrong | F.when(text.isNull(), ready).otherwise(~shaped)
    for name, limit in STATEMENT_TEXTS.items():
        wrong = wrong | (F.coalesce(F.length(name), F.lit(0)) > limit)
    unbound = ~F.coalesce(F.col("document_id").rlike(OPAQUE_ID) & F.col("file_id").rlike(OPAQUE_ID), F.lit(False))
    status = events.select("entry_id", F.col("status").alias("_status"))
    rows = statements.join(status, "entry_id")

    def repeated(name):
        return rows.groupBy("entry_id", name).agg(F.count("*").alias("n")).filter("n > 1").select("entry_id")

    repeats = repeated("document_id").unionByName(repeated("file_id")).distinct().withColumn("repeated", F.lit(True))
    folded = rows.groupBy("entry_id").agg(
        F.count("*").alias("statement_rows"), F.bool_or(unbound).alias("unbound"), F.bool_or(wrong).alias("wrong"),
    )
    expected = events.select("entry_id", *[F.col(c).alias(f"event_{c}") for c in ("status", "expected_document_count", "extracted_document_count")])
    joined = expected.join(summaries, "entry_id", "left").join(folded, "entry_id", "left").join(repeats, "entry_id", "left")
    agrees = (
        (F.col("analysis_version") == 1)
        & (F.col("analysis_status") == F.col("event_status"))
        & (F.col("expected_document_count") == F.col("event_expected_document_count"))
        & (F.col("extracted_document_count") == F.col("event_extracted_document_count"))
        & F.col("all_documents_processed")
        & (F.col("pdf_layout_version") == LAYOUT_VERSION)
        & F.col("pdf_source_generation").rlike(DIGITS)
        & F.lower("pdf_source_sha256").rlike(SHA256)
        & F.lower("summary_fingerprint").rlike(SHA256)
    )
    key_ok = F.length("pdf_gcs_key") <= 1024
    count_ok = F.coalesce("statement_rows", F.lit(0)) == F.col("event_extracted_document_count")
    no = F.lit(False)
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce(agrees, no), "SUMMARY_EVENT_MISMATCH"),
            F.when(~F.coalesce(key_ok, no), "SUMMARY_PDF_GCS_KEY_INVALID"),
            F.when(~F.coalesce(count_ok, no), "SUMMARY_STATEMENT_COUNT_MISMATCH"),
            F.when(F.coalesce(F.col("unbound"), no) | F.col("repeated").isNotNull(), "SUMMARY_DOCUMENT_BINDING_INVALID"),
            F.when(F.col("wrong"), "SUMMARY_STATEMENT_INVALID"),
        )
    )
    return joined.select("entry_id", errors.alias("errors"))

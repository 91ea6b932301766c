"""Report rows, fingerprints, attachments and recipients."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import package_on_workers
from .running import globally_numbered

ATTACHMENT_BYTES = 24 * 1024 * 1024
# Labels of the sales buckets.
SALES_BUCKETS = {
    "gt_5m": "Greater than $5M",
    "1m_5m": "$1M – $5M",
    "500k_1m": "$500K – $1M",
    "100k_500k": "$100K – $500K",
    "lt_100k": "Less than $100K",
}


def report_statements(summary: DataFrame, calculated: DataFrame) -> DataFrame:
    """Statement rows of a report: masked account, money as exact text."""
    numbers = T.digits(F.coalesce("account_number", F.lit("")))
    details = calculated.select(
        "entry_id", "document_id", "document_index", "file_id", "num_credits", "calculated_total_debits",
        F.nullif(F.regexp_extract(numbers, "([0-9]{4})$", 1), F.lit("")).alias("account_last_four"),
    )
    detected = (
        F.when(F.size("mca_positions") > 0, "Yes")
        .when(F.array_contains("quality_reasons", "MCA_CANDIDATE_UNCONFIRMED"), "Review")
        .otherwise(T.DASH)
    )
    return summary.join(details, ["entry_id", "document_id", "document_index", "file_id"]).select(
        "entry_id", "document_id", "document_index", "file_id", "account_last_four",
        F.col("statement_start_date").cast("string").alias("statement_start_date"),
        F.col("statement_end_date").cast("string").alias("statement_end_date"),
        F.col("total_deposits").cast("string").alias("deposits"),
        F.col("num_credits").alias("deposit_count"),
        F.col("true_deposits").cast("string").alias("true_revenue"),
        F.col("calculated_total_debits").cast("string").alias("withdrawals"),
        F.col("negative_balance_days").alias("negative_ending_days"),
        F.col("average_daily_balance").cast("string").alias("average_daily_balance"),
        detected.alias("mca_detected"),
        "quality_status",
    )


def report_metadata(summary: DataFrame, submissions: DataFrame) -> DataFrame:
    """Summary status with the source document, and whether the entry is unique."""
    sources = submissions.select("entry_id", "pdf_gcs_key", "pdf_layout_version", "pdf_source_generation", "pdf_source_sha256")
    counts = sources.groupBy("entry_id").agg(F.count("*").alias("source_rows"))
    return (
        summary.select(
            "entry_id", "analysis_version", "analysis_status", "expected_document_count",
            "extracted_document_count", "all_documents_processed",
        )
        .join(sources, "entry_id")
        .join(counts, "entry_id")
    )


STATEMENT_FIELDS = [
    "document_id", "document_index", "file_id", "account_last_four", "statement_start_date",
    "statement_end_date", "deposits", "deposit_count", "true_revenue", "withdrawals",
    "negative_ending_days", "average_daily_balance", "mca_detected", "quality_status",
]


MONEY_FIELDS = ["deposits", "true_revenue", "withdrawals", "average_daily_balance"]
HEADER_FIELDS = ["entry_id", "analysis_version", "analysis_status", "expected_document_count", "extracted_document_count", "all_documents_processed"]
DISPLAY_ORDER = ["statement_start_date", "statement_end_date", "document_index", "document_id"]


def plain_number(text: Column) -> Column:
    """A decimal's text without zeros behind its last digit."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _display_digests(batches):
    """Per entry, of a partition sorted in display order with each entry's header first: SHA-256 of its JSON text."""
    entry, digest, lines = None, None, 0
    for batch in batches:
        done = []
        for own, line, header in zip(*(batch.column(c).to_pylist() for c in ("entry_id", "line", "header"))):
            if header:
                if digest is not None:
                    done.append((entry, digest))
                entry, digest, lines = own, hashlib.sha256(line[:-1].encode() + b',"statements":['), 0
            elif digest is not None and own == entry:
                digest.update((b"," if lines else b"") + line.encode())
                lines += 1
        yield _finished(done)
    yield _finished([] if digest is None else [(entry, digest)])


def _finished(done: list) -> pa.RecordBatch:
    for _, digest in done:
        digest.update(b"]}")
    return pa.RecordBatch.from_arrays([pa.array([e for e, _ in done], pa.string()), pa.array([d.hexdigest() for _, d in done], pa.string())], ["entry_id", "summary_fingerprint"])


def summary_fingerprints(summary: DataFrame, statements: DataFrame, fields: list[str] = STATEMENT_FIELDS) -> DataFrame:
    """SHA-256 of the displayed summary of each submission: of the JSON text of its header fields and its ``statements``
    in display order, amounts as plain numbers in quotes.

    One sorted pass: the header and the lines of an entry go to one partition in order, and the digest is carried from
    line to line. So no text and no list of an entry is ever built; the lines of an entry are read by one task, as a
    digest needs them in order.
    """
    package_on_workers(summary.sparkSession)
    shown = [plain_number(F.col(c)).alias(c) if c in MONEY_FIELDS else F.col(c) for c in fields]
    as_text = {"ignoreNullFields": "false"}
    lines = statements.select("entry_id", F.lit(False).alias("header"), *DISPLAY_ORDER, F.to_json(F.struct(*shown), as_text).alias("line"))
    kinds = {c: statements.schema[c].dataType for c in DISPLAY_ORDER}
    heads = summary.select(
        "entry_id", F.lit(True).alias("header"), *[F.lit(None).cast(kinds[c]).alias(c) for c in DISPLAY_ORDER],
        F.to_json(F.struct(*HEADER_FIELDS), as_text).alias("line"))
    both = heads.unionByName(lines).repartition("entry_id").sortWithinPartitions("entry_id", F.col("header").desc(), *DISPLAY_ORDER, "line")
    return both.select("entry_id", "line", "header").mapInArrow(_display_digests, "entry_id string, summary_fingerprint string")


def rows_in_order(statements: DataFrame) -> DataFrame:
    """Statement rows with their number in the order of entries and of display (``row``), and in their entry (``place``)."""
    numbered = globally_numbered(statements, ["entry_id", *DISPLAY_ORDER, "file_id"], "row")
    first = numbered.groupBy("entry_id").agg(F.min("row").alias("first"))
    return numbered.join(first, "entry_id").withColumn("place", F.col("row") - F.col("first") + 1).drop("first")


def report_lines(statements: DataFrame) -> DataFrame:
    """Heading and two detail lines for every statement row."""
    def money(name):
        return T.exact_decimal(F.col(name))

    def shown(name):
        return F.coalesce(F.nullif(T.printable(F.col(name)), F.lit("")), F.lit(T.DASH))

    detected = (
        F.when(F.col("mca_detected") == "Yes", "Yes")
        .when((F.col("mca_detected") == "Review") | (F.col("quality_status") == "REVIEW_REQUIRED"), "Review")
        .otherwise(T.DASH)
    )
    account = F.when(F.col("account_last_four").rlike("^[0-9]{4}$"), F.concat(F.lit("**** "), "account_last_four")).otherwise(T.DASH)
    return statements.select(
        "entry_id", "document_id", "file_id",
        F.concat(T.display_period(F.col("statement_start_date"), F.col("statement_end_date")), F.lit(" | Account "), account).alias("heading"),
        F.concat(
            F.lit("Deposits: "), money("deposits"), F.lit(" | Deposit count: "), shown("deposit_count"),
            F.lit(" | True revenue: "), money("true_revenue"), F.lit(" | Withdrawals: "), money("withdrawals"),
        ).alias("money_line"),
        F.concat(
            F.lit("Negative ending days: "), shown("negative_ending_days"), F.lit(" | Avg. daily balance: "),
            money("average_daily_balance"), F.lit(" | MCA detected: "), detected,
        ).alias("balance_line"),
        (detected == "Review").alias("review"),
    )


def submission_report(submissions: DataFrame) -> DataFrame:
    """Grouped label/value rows per submission plus its subject line."""
    def text(name):
        return T.or_dash(F.col(name))

    bucket = F.create_map(*[F.lit(x) for pair in SALES_BUCKETS.items() for x in pair])
    sales = F.col("gross_annual_sales_bucket")
    industry = F.when(
        (F.col("industry") == "Other") & (F.coalesce("industry_other", F.lit("")) != ""),
        F.concat(F.lit("Other — "), F.col("industry_other")),
    ).otherwise(text("industry"))
    started = F.when(
        (F.col("business_started_month") >= 1) & (F.col("business_started_year") != 0),
        F.concat(
            F.date_format(F.make_date(F.lit(2000), F.col("business_started_month").cast("int"), F.lit(1)), "MMMM"),
            F.lit(" "), F.col("business_started_year"),
        ),
    )
    amount = F.col("requested_funding_amount")
    share = F.col("owner_ownership_percentage")
    place = [F.col(f"business_physical_{n}") for n in ("street", "city", "state", "zip")]
    home = [F.col(f"owner_address_{n}") for n in ("street", "city", "state", "zip")]
    groups = {
        "Submission Metadata": {
            "Entry ID": text("entry_id"),
            "Submitted At": T.eastern(F.col("submitted_at"), "MMM d, yyyy, h:mm a"),
            "Rep (app param)": text("app_param"),
            "UTM Source": text("utm_source"), "UTM Medium": text("utm_medium"),
            "UTM Campaign": text("utm_campaign"), "Referrer": text("referrer"),
        },
        "Primary Contact": {
            "Full Name": text("contact_name"), "Email": text("contact_email"), "Phone": text("contact_phone"),
        },
        "Business": {
            "Legal Business Name": text("business_legal_name"), "DBA": text("dba"),
            "Physical Address": T.join_parts(*place), "Industry": industry,
            "State of Incorporation": text("state_of_incorporation"),
            "Date Business Started": F.coalesce(started, F.lit(T.DASH)),
            "Federal Tax ID (EIN)": text("federal_tax_id"), "Entity Type": text("business_entity_type"),
            "Gross Annual Sales": F.coalesce(F.try_element_at(bucket, sales), F.nullif(sales, F.lit("")), F.lit(T.DASH)),
            "Requested Funding Amount": T.usd_number(amount),
        },
        "Primary Owner": {
            "Full Name": text("owner_full_name"),
            "Ownership %": F.when(share != 0, F.concat(share.cast("string"), F.lit("%"))).otherwise(T.DASH),
            "SSN": text("owner_ssn"), "Date of Birth": text("owner_dob"),
            "Home Address": T.join_parts(*home),
        },
    }
    fields = [
        F.struct(
            F.lit(g + 1).alias("group_index"), F.lit(title).alias("group_title"), F.lit(i + 1).alias("field_index"),
            F.lit(label).alias("label"), value.alias("value"),
        )
        for g, (title, entries) in enumerate(groups.items())
        for i, (label, value) in enumerate(entries.items())
    ]
    subject = F.concat_ws(" - ", text("business_legal_name"), F.lit("Submission"), T.eastern(F.col("submitted_at"), "M/d/yyyy"))
    return submissions.select("entry_id", subject.alias("subject"), F.explode(F.array(*fields)).alias("f")).select(
        "entry_id", "subject", "f.*"
    )


def pack_attachments(application_bytes: Column, sizes: Column, uris: Column, budget: int = ATTACHMENT_BYTES) -> Column:
    """Struct of error, kept positions (1-based), total bytes and truncated flag.

    Files are taken in order; one that would exceed the budget is passed over
    and later ones may still fit.
    """
    start = F.struct(
        application_bytes.cast("bigint").alias("total"), F.array().cast("array<int>").alias("kept"),
        F.lit(0).alias("position"),
    )

    def add(state, size):
        fits = state["total"] + size <= budget
        place = state["position"] + 1
        return F.struct(
            F.when(fits, state["total"] + size).otherwise(state["total"]).alias("total"),
            F.when(fits, F.array_append(state["kept"], place)).otherwise(state["kept"]).alias("kept"),
            place.alias("position"),
        )

    packed = F.aggregate(F.transform(sizes, lambda s: s.cast("bigint")), start, add)
    error = F.when(F.size(F.array_distinct(uris)) < F.size(uris), "BANK_KEYS_INVALID").when(
        application_bytes > budget, "APPLICATION_PDF_TOO_LARGE"
    )
    usable = error.isNull()
    return F.struct(
        error.alias("error"),
        F.when(usable, packed["kept"]).alias("kept"),
        F.when(usable, packed["total"]).alias("total_bytes"),
        F.when(usable, F.size(packed["kept"]) < F.size(sizes)).alias("truncated"),
    )


MAP_ROUTES = 1_000


def route_recipients(submissions: DataFrame, defaults: list[str], extras: dict[str, list[str]] | DataFrame) -> DataFrame:
    """Default recipients plus those of the representative, without repeats.

    ``extras`` is a configuration by representative, or a table of it (app_key, recipients; of a key that is repeated
    all count, in the order of the lists). A short configuration is part of the plan, all else is joined.
    """
    key = F.lower(F.coalesce(T.clean(F.col("app_param")), F.lit("")))
    base = F.array(*map(F.lit, defaults)).cast("array<string>")
    none = F.array().cast("array<string>")
    rows = submissions.select("entry_id", key.alias("app_key"))
    if isinstance(extras, dict) and len(extras) <= MAP_ROUTES:
        extra = none
        if extras:
            routes = F.create_map(*[x for k, v in extras.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
            extra = F.coalesce(F.try_element_at(routes, F.col("app_key")), none)
    else:
        if isinstance(extras, dict):
            extras = submissions.sparkSession.createDataFrame(list(extras.items()), "app_key string, recipients array<string>")
        routes = extras.groupBy("app_key").agg(F.flatten(F.array_sort(F.collect_list("recipients"))).alias("_extra"))
        rows, extra = rows.join(routes, "app_key", "left"), F.coalesce("_extra", none)
    return rows.select("entry_id", "app_key", F.array_distinct(F.concat(base, extra)).alias("recipients"))

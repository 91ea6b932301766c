"""Application intake: flattening and checking submitted payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions import urls as L
from ..schemas import EXACT, MONEY, PAYLOAD, STATEMENT, SUMMARY_KEYS, TRANSACTION_KEYS

STORAGE = "gs://application-files/"
MAX_FILES = 10
WIDE = "decimal(38,18)"


def sanitize_payload(payload: Column) -> Column:
    """Payload text without the form's signature; other fields, known or not,
    stay as they are, and anything but an object passes through."""
    form = F.get_json_object(payload, "$.formData")
    outer = F.from_json(payload, "map<string,variant>")
    inner = F.from_json(form, "map<string,variant>")
    cleaned = F.map_filter(inner, lambda k, v: k != "signature")
    rest = F.map_filter(outer, lambda k, v: k != "formData")
    merged = F.map_concat(rest, F.create_map(F.lit("formData"), F.parse_json(F.to_json(cleaned))))
    is_form = F.coalesce(form.startswith("{"), F.lit(False))
    return F.when(is_form & inner.isNotNull(), F.to_json(merged)).otherwise(payload)


def flatten_submissions(payloads: DataFrame) -> DataFrame:
    """Flat typed rows from (payload, submitted_at, forwarded_for, remote_address,
    user_agent, bank_files). The id comes from the content, so a replayed payload
    gives the same row."""
    parsed = payloads.withColumn("p", F.from_json("payload", PAYLOAD))
    form, owner = F.col("p.formData"), F.col("p.formData.owner")
    place, home = form["physicalAddress"], owner["address"]
    month = T.finite_number(form["businessStartedMonth"])
    year = T.finite_number(form["businessStartedYear"])
    both = (month != 0) & (year != 0)
    entry = F.concat(F.lit("app_"), F.substring(F.sha2(F.concat_ws("\n", F.col("payload"), F.col("submitted_at").cast("string")), 256), 1, 32))
    business = T.slug(form["businessLegalName"])
    where = F.concat(F.lit(STORAGE), business, F.lit("_"), entry)

    def taken(struct, name, alias):
        return T.clean(struct[name]).alias(alias)

    return parsed.select(
        entry.alias("entry_id"),
        "submitted_at",
        T.clean(F.col("p.appParam")).alias("app_param"),
        *[taken(F.col("p.utm"), n, n) for n in ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "referrer")],
        F.coalesce(T.first_hop(F.col("forwarded_for")), F.col("remote_address")).alias("ip_address"),
        F.nullif(F.substring("user_agent", 1, 500), F.lit("")).alias("user_agent"),
        taken(form, "contactName", "contact_name"),
        taken(form, "contactEmail", "contact_email"),
        taken(form, "contactPhone", "contact_phone"),
        taken(form, "businessLegalName", "business_legal_name"),
        taken(form, "dba", "dba"),
        *[taken(place, n, f"business_physical_{n}") for n in ("street", "city", "state", "zip")],
        taken(form, "industry", "industry"),
        taken(form, "industryOther", "industry_other"),
        taken(form, "stateOfIncorporation", "state_of_incorporation"),
        F.when(both, month).cast("bigint").alias("business_started_month"),
        F.when(both, year).cast("bigint").alias("business_started_year"),
        taken(form, "federalTaxId", "federal_tax_id"),
        taken(form, "businessEntityType", "business_entity_type"),
        taken(form, "grossAnnualSalesBucket", "gross_annual_sales_bucket"),
        T.clean(form["requestedFundingAmount"]).try_cast(EXACT).alias("requested_funding_amount"),
        *[T.clean_capped(F.col("p.underwriting")[n], size).alias(n) for n, size in L.UNDERWRITING_PARAMS.items()],
        taken(owner, "fullName", "owner_full_name"),
        T.finite_number(owner["ownershipPercentage"]).cast("bigint").alias("owner_ownership_percentage"),
        taken(owner, "ssn", "owner_ssn"),
        T.clean(owner["dateOfBirth"]).try_cast("date").alias("owner_dob"),
        *[taken(home, n, f"owner_address_{n}") for n in ("street", "city", "state", "zip")],
        F.transform(
            "bank_files", lambda name, i: F.concat(where, F.lit("/"), T.safe_filename(name, i + 1))
        ).alias("bank_statement_gcs_keys"),
        F.concat(where, F.lit("/"), business, F.lit("_"), entry, F.lit(".pdf")).alias("pdf_gcs_key"),
        where.alias("gcs_folder"),
        T.clean(form["signature"]).isNotNull().alias("signature_captured"),
        F.coalesce(form["termsAccepted"] == "true", F.lit(False)).alias("terms_accepted"),
        sanitize_payload(F.col("payload")).alias("raw_payload_json"),
    )


def form_errors(submissions: DataFrame) -> DataFrame:
    """Submissions with the codes of every field that fails its form check."""
    def missing(name):
        return F.coalesce(F.col(name) == "", F.lit(True)) | F.col(name).isNull()

    def misshaped(name, pattern):
        return ~F.coalesce(F.col(name).rlike(pattern), F.lit(False))

    share = F.col("owner_ownership_percentage")
    checks = {
        "contact_email": misshaped("contact_email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
        "business_legal_name": missing("business_legal_name"),
        "business_street": missing("business_physical_street"),
        "business_city": missing("business_physical_city"),
        "business_state": missing("business_physical_state"),
        "business_zip": misshaped("business_physical_zip", r"^\d{5}$"),
        "industry": missing("industry"),
        "industry_other": (F.col("industry") == "Other") & missing("industry_other"),
        "state_of_incorporation": missing("state_of_incorporation"),
        "business_started": F.col("business_started_month").isNull() | F.col("business_started_year").isNull(),
        "federal_tax_id": misshaped("federal_tax_id", r"^\d{2}-\d{7}$"),
        "business_entity_type": missing("business_entity_type"),
        "gross_annual_sales_bucket": missing("gross_annual_sales_bucket"),
        "requested_funding_amount": F.col("requested_funding_amount") <= 0,
        "owner_full_name": missing("owner_full_name"),
        "owner_ownership_percentage": share.isNull() | (share < 1) | (share > 100),
        "owner_ssn": misshaped("owner_ssn", r"^\d{3}-\d{2}-\d{4}$"),
        "owner_dob": F.col("owner_dob").isNull(),
        "owner_street": missing("owner_address_street"),
        "owner_city": missing("owner_address_city"),
        "owner_state": missing("owner_address_state"),
        "owner_zip": misshaped("owner_address_zip", r"^\d{5}$"),
        "signature": ~F.col("signature_captured"),
        "terms": ~F.col("terms_accepted"),
    }
    return submissions.withColumn(
        "errors", F.array_compact(F.array(*[F.when(bad, code) for code, bad in checks.items()]))
    )


def files_error(files: Column, limit: int = MAX_FILES) -> Column:
    """Error code of an application with more files than one may have; its row keeps them all."""
    return F.when(F.size(files) > limit, "TOO_MANY_FILES")


def parse_extractions(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posted extraction rows (``value`` JSON text) split into typed rows and
    rejects. Every summary and transaction key must be present, null or not. An
    amount has to fit the money type as it stands: rows with fractions of a cent,
    longer amounts or no numbers are rejected, and nothing is rounded."""
    row = (
        "entry_id string, document_id string, document_index bigint, file_id string, "
        f"extracted_at timestamp, statement {STATEMENT}"
    )
    summary = F.json_object_keys(F.get_json_object("value", "$.statement.summary"))
    lines = F.from_json(F.get_json_object("value", "$.statement.transactions"), "array<map<string,variant>>")
    has_summary = F.size(F.array_except(F.array(*map(F.lit, SUMMARY_KEYS)), summary)) == 0
    wanted = F.array(*map(F.lit, TRANSACTION_KEYS))
    has_lines = F.forall(lines, lambda t: F.size(F.array_except(wanted, F.map_keys(t))) == 0)
    parsed = messages.withColumn("r", F.from_json("value", row, {"mode": "PERMISSIVE"}))
    # The same amounts with more places on both sides, to see what the money type would have changed.
    wide = F.from_json("value", f"statement {STATEMENT.replace(MONEY, WIDE)}")["statement"]
    fits = F.forall(
        F.arrays_zip(F.col("r.statement.transactions").alias("kept"), wide["transactions"].alias("said"), lines.alias("raw")),
        lambda t: F.is_variant_null(t["raw"]["amount"]) | F.coalesce(t["kept"]["amount"] == t["said"]["amount"], F.lit(False)))
    for name in ("start_balance", "end_balance", "total_credits", "total_debits"):
        said = F.get_json_object("value", f"$.statement.summary.{name}").isNotNull()
        same = F.coalesce(F.col(f"r.statement.summary.{name}") == wide["summary"][name], F.lit(False))
        fits = fits & (~said | same)
    identified = F.lit(True)
    for name in ("entry_id", "document_id", "document_index", "file_id", "extracted_at"):
        identified = identified & F.col(f"r.{name}").isNotNull()
    good = F.coalesce(identified & has_summary & has_lines & fits, F.lit(False))
    checked = parsed.withColumn("_good", good)
    return checked.filter("_good").select("r.*"), checked.filter(~F.col("_good")).select("value")


def row_payload(submissions: DataFrame) -> DataFrame:
    """Each submission as JSON text with its raw payload expanded, or kept as
    text when it is not valid JSON."""
    row = F.parse_json(F.to_json(F.struct(*[c for c in submissions.columns if c != "raw_payload_json"]), {"ignoreNullFields": "false"}))
    raw = F.try_parse_json("raw_payload_json")
    text = F.when(raw.isNotNull(), F.to_json(F.struct(row.alias("submission"), raw.alias("raw_payload")))).otherwise(
        F.to_json(F.struct(row.alias("submission"), F.col("raw_payload_json").alias("raw_payload")))
    )
    return submissions.select("entry_id", text.alias("body"))


"""Registered queries over intake, ledger, events, reports and journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import events as EV, intake, ledger as LG, reporting as R, web as W
from . import app_tables as A
from .app_tables import read
from .statement_oracle import chained
from .statement_queries import chain, from_chain, register

_e = F.expr

# ---- intake ---------------------------------------------------------------

_PAYLOAD_FIELDS = f"""
  SELECT 'app_' || substr(sha256(payload || chr(10) || submitted_at), 1, 32) AS entry_id, c, name, n, segment AS app_param,
    'src' || n AS utm_source, CAST(NULL AS VARCHAR) AS utm_medium,
    CASE WHEN c % 4 = 0 THEN '192.0.2.1' ELSE '10.0.' || c % 7 || '.1' END AS ip_address,
    nullif(substr(repeat('agent ', CAST(c % 120 AS INT)), 1, 500), '') AS user_agent,
    CASE WHEN c % 9 = 0 THEN 'nobody' ELSE 'c' || c || '@example.com' END AS contact_email,
    name || ' & Sons' AS business_legal_name,
    lower(regexp_replace(replace(name, '&', 'and'), '[^A-Za-z0-9]+', '-', 'g')) || '-and-sons' AS slug,
    c || ' Main St' AS street, 'Town' || n AS city, CAST(10000 + c % 90000 AS VARCHAR) AS zip,
    CASE WHEN c % 5 = 0 THEN 'Other' ELSE 'Retail' END AS industry,
    CASE WHEN c % 13 <> 0 THEN c % 13 END AS started_month, CASE WHEN c % 13 <> 0 THEN 1990 + c % 30 END AS started_year,
    (10 + c % 90) || '-' || (1000000 + c) AS tax_id,
    CASE WHEN c % 3 = 0 THEN 'gt_5m' WHEN c % 3 = 1 THEN '500k_1m' ELSE 'odd' END AS sales,
    CASE WHEN bal % 4 <> 0 THEN bal * 10 END AS amount,
    CAST(bal AS VARCHAR) AS avg_monthly_deposits, nullif(rtrim(substr(rtrim(repeat('lender ', CAST(c % 100 AS INT))), 1, 600)), '') AS open_mca_text,
    nullif(substr(rtrim(repeat('lender ', CAST(c % 100 AS INT))), 1, 600), '') AS open_mca,
    c % 110 AS share, (100 + c % 800) || '-' || (10 + c % 80) || '-' || (1000 + c % 9000) AS ssn,
    TRY_CAST((1950 + c % 50) || '-0' || (1 + c % 9) || '-' || (10 + c % 22) AS DATE) AS dob,
    c || ' Home Rd' AS home_street, '0700' || c % 10 AS home_zip,
    c % 8 <> 0 AS signed, c % 10 <> 0 AS accepted, 1 + c % 3 AS files
  FROM ({A.PAYLOADS})"""


def _flat(spark, sf_dir):
    return intake.flatten_submissions(A.customer_payloads(spark, sf_dir))


@register(
    "flattened_submissions",
    "entry_id:s app_param:s utm_source:s utm_medium:s ip_address:s user_agent:s contact_email:s business_legal_name:s street:s city:s zip:s "
    "industry:s started_month:n started_year:n tax_id:s sales:s amount:m avg_monthly_deposits:s open_mca:s share:n ssn:s dob:d signed:b accepted:b folder:s files:n first_file:s",
    f"""SELECT *, 'gs://application-files/' || slug || '_' || entry_id AS folder,
      'gs://application-files/' || slug || '_' || entry_id || '/bank_01_state ment_1.pdf' AS first_file FROM ({_PAYLOAD_FIELDS})""",
)
def _(spark, sf_dir):
    return _flat(spark, sf_dir).withColumnsRenamed({
        "business_physical_street": "street", "business_physical_city": "city", "business_physical_zip": "zip",
        "business_started_month": "started_month", "business_started_year": "started_year", "federal_tax_id": "tax_id",
        "gross_annual_sales_bucket": "sales", "requested_funding_amount": "amount", "owner_ownership_percentage": "share",
        "owner_ssn": "ssn", "owner_dob": "dob", "signature_captured": "signed", "terms_accepted": "accepted", "gcs_folder": "folder",
    }).withColumn("files", F.size("bank_statement_gcs_keys")).withColumn("first_file", F.get("bank_statement_gcs_keys", F.lit(0)))


@register(
    "sanitized_payloads", "entry_id:s has_signature:b extra_kept:s name:s",
    f"SELECT entry_id, false AS has_signature, '{{\"kept\":true}}' AS extra_kept, name FROM ({_PAYLOAD_FIELDS})",
)
def _(spark, sf_dir):
    raw = F.col("raw_payload_json")
    return _flat(spark, sf_dir).select(
        "entry_id",
        F.array_contains(F.json_object_keys(F.get_json_object(raw, "$.formData")), "signature").alias("has_signature"),
        F.get_json_object(raw, "$.formData.extra").alias("extra_kept"),
        F.get_json_object(raw, "$.formData.contactName").alias("name"),
    )


@register(
    "form_errors", "entry_id:s errors:l",
    f"""SELECT entry_id, [x FOR x IN [
        CASE WHEN c % 9 = 0 THEN 'contact_email' END,
        CASE WHEN industry = 'Other' THEN 'industry_other' END,
        CASE WHEN started_month IS NULL THEN 'business_started' END,
        CASE WHEN NOT regexp_full_match(tax_id, '[0-9]{{2}}-[0-9]{{7}}') THEN 'federal_tax_id' END,
        CASE WHEN amount <= 0 THEN 'requested_funding_amount' END,
        CASE WHEN share < 1 OR share > 100 THEN 'owner_ownership_percentage' END,
        CASE WHEN dob IS NULL THEN 'owner_dob' END,
        CASE WHEN NOT signed THEN 'signature' END,
        CASE WHEN NOT accepted THEN 'terms' END] IF x IS NOT NULL] AS errors FROM ({_PAYLOAD_FIELDS})""",
)
def _(spark, sf_dir):
    return intake.form_errors(_flat(spark, sf_dir))


@register(
    "submission_report", "entry_id:s group_index:n field_index:n label:s value:s",
    f"""SELECT entry_id, f.g AS group_index, f.i AS field_index, f.l AS label, f.v AS value FROM (SELECT entry_id, unnest([
        {{'g': 1, 'i': 1, 'l': 'Entry ID', 'v': entry_id}}, {{'g': 1, 'i': 2, 'l': 'Submitted At', 'v': 'Feb 1, 2024, 10:30 AM'}},
        {{'g': 1, 'i': 3, 'l': 'Rep (app param)', 'v': app_param}}, {{'g': 1, 'i': 4, 'l': 'UTM Source', 'v': utm_source}},
        {{'g': 1, 'i': 5, 'l': 'UTM Medium', 'v': '—'}}, {{'g': 1, 'i': 6, 'l': 'UTM Campaign', 'v': '—'}}, {{'g': 1, 'i': 7, 'l': 'Referrer', 'v': '—'}},
        {{'g': 2, 'i': 1, 'l': 'Full Name', 'v': name}}, {{'g': 2, 'i': 2, 'l': 'Email', 'v': contact_email}}, {{'g': 2, 'i': 3, 'l': 'Phone', 'v': '—'}},
        {{'g': 3, 'i': 1, 'l': 'Legal Business Name', 'v': business_legal_name}}, {{'g': 3, 'i': 2, 'l': 'DBA', 'v': '—'}},
        {{'g': 3, 'i': 3, 'l': 'Physical Address', 'v': street || ', ' || city || ', NY, ' || zip}}, {{'g': 3, 'i': 4, 'l': 'Industry', 'v': industry}},
        {{'g': 3, 'i': 5, 'l': 'State of Incorporation', 'v': 'DE'}},
        {{'g': 3, 'i': 6, 'l': 'Date Business Started', 'v': coalesce(monthname(make_date(2000, started_month, 1)) || ' ' || started_year, '—')}},
        {{'g': 3, 'i': 7, 'l': 'Federal Tax ID (EIN)', 'v': tax_id}}, {{'g': 3, 'i': 8, 'l': 'Entity Type', 'v': 'Partnership'}},
        {{'g': 3, 'i': 9, 'l': 'Gross Annual Sales', 'v': CASE sales WHEN 'gt_5m' THEN 'Greater than $5M' WHEN '500k_1m' THEN '$500K – $1M' ELSE sales END}},
        {{'g': 3, 'i': 10, 'l': 'Requested Funding Amount', 'v': CASE WHEN amount IS NULL THEN '—' ELSE '$' || format('{{:,}}', amount) END}},
        {{'g': 4, 'i': 1, 'l': 'Full Name', 'v': 'Owner ' || c}}, {{'g': 4, 'i': 2, 'l': 'Ownership %', 'v': CASE WHEN share = 0 THEN '—' ELSE share || '%' END}},
        {{'g': 4, 'i': 3, 'l': 'SSN', 'v': ssn}}, {{'g': 4, 'i': 4, 'l': 'Date of Birth', 'v': coalesce(CAST(dob AS VARCHAR), '—')}},
        {{'g': 4, 'i': 5, 'l': 'Home Address', 'v': home_street || ', Town, NJ, ' || home_zip}}]) AS f FROM ({_PAYLOAD_FIELDS}))""",
)
def _(spark, sf_dir):
    return R.submission_report(_flat(spark, sf_dir))


ROUTES = {"building": ["desk-b@example.com"], "machinery": ["desk-m@example.com", "all@example.com"]}


@register(
    "routed_recipients", "entry_id:s app_key:s recipients:l",
    f"""SELECT entry_id, lower(app_param) AS app_key, CASE lower(app_param) WHEN 'building' THEN ['all@example.com', 'desk-b@example.com']
      WHEN 'machinery' THEN ['all@example.com', 'desk-m@example.com'] ELSE ['all@example.com'] END AS recipients FROM ({_PAYLOAD_FIELDS})""",
)
def _(spark, sf_dir):
    return R.route_recipients(_flat(spark, sf_dir), ["all@example.com"], ROUTES)


@register(
    "routed_by_table", "entry_id:s app_key:s recipients:l",
    f"""SELECT entry_id, lower(app_param) AS app_key, list_concat(['all@example.com'], (SELECT list('nation' || n_nationkey || '@example.com' ORDER BY n_nationkey) FROM nation
      WHERE n_nationkey % 7 = length(app_param) % 7)) AS recipients FROM ({_PAYLOAD_FIELDS})""",
)
def _(spark, sf_dir):
    flat = _flat(spark, sf_dir)
    keys = flat.select(F.lower("app_param").alias("app_key")).distinct()
    nations = read(spark, sf_dir, "nation").select("n_nationkey")
    routes = keys.join(nations, F.length("app_key") % 7 == F.col("n_nationkey") % 7).groupBy("app_key").agg(F.array_sort(F.collect_list("n_nationkey")).alias("n"))
    return R.route_recipients(flat, ["all@example.com"], routes.select("app_key", F.transform("n", lambda n: F.concat(F.lit("nation"), n, F.lit("@example.com"))).alias("recipients")))


@register(
    "submission_messages", "entry_id:s body:s attributes:s",
    f"""SELECT entry_id, '{{"entry_id":"' || entry_id || '","gcs_folder":"gs://application-files/' || slug || '_' || entry_id || '"}}' AS body,
      '{{"entry_id":"' || entry_id || '"}}' AS attributes FROM ({_PAYLOAD_FIELDS})""",
)
def _(spark, sf_dir):
    flat = _flat(spark, sf_dir).withColumn("pdf_layout_version", F.lit(None).cast("string"))
    return EV.submission_messages(flat).select(F.col("key").alias("entry_id"), F.col("value").alias("body"), F.to_json("attributes").alias("attributes"))


@from_chain(
    "posted_extractions", "entry_id:s accepted:n rejected:n",
    """SELECT entry_id, count(*) FILTER (WHERE whole) AS accepted, count(*) FILTER (WHERE NOT whole) AS rejected FROM (
         SELECT entry_id, account_number IS NOT NULL AND start_balance IS NOT NULL AND end_balance IS NOT NULL
           AND len([l FOR l IN lines IF l.d IS NULL OR l.amount IS NULL]) = 0 AS whole FROM extracted) GROUP BY entry_id""",
)
def _(u):
    # Written without its null fields, a row lacks the keys the contract wants.
    posted = u.extractions.select(F.to_json(F.struct(*u.extractions.columns)).alias("value"))
    good, bad = intake.parse_extractions(posted)
    both = good.select("entry_id", F.lit(1).alias("good")).unionByName(
        bad.select(F.get_json_object("value", "$.entry_id").alias("entry_id"), F.lit(0).alias("good"))
    )
    return both.groupBy("entry_id").agg(F.sum("good").alias("accepted"), F.sum(1 - F.col("good")).alias("rejected"))


# ---- ledger ---------------------------------------------------------------


@register(
    "fanned_out_documents", "entry_id:s document_id:s document_index:n gcs_uri:s error_code:s",
    f"""SELECT DISTINCT entry_id, CASE WHEN error_code IS NULL THEN document_id END AS document_id,
      CASE WHEN error_code IS NULL THEN i END AS document_index, CASE WHEN error_code IS NULL THEN uri END AS gcs_uri, error_code FROM ({A.FANNED})""",
)
def _(spark, sf_dir):
    return LG.fan_out_documents(A.order_submissions(spark, sf_dir))


def _old_ledger(fanned):
    kept = fanned.filter("k % 2 = 0")
    return A.to_ledger(kept.select(
        "document_id", "entry_id", "submitted_at", "document_type", "document_index", "gcs_uri",
        _e("1 + k % 3").alias("attempt_count"), _e("case when k % 3 = 0 then null else 'openai' end").alias("extraction_provider"),
        _e("case when k % 4 = 0 then null else 'RUNNING' end").alias("provider_status"), F.lit("UPLOADED").alias("ingestion_status"),
        _e("timestamp '2024-01-01 00:00:00'").alias("updated_at"),
    ))


@register(
    "upserted_documents", "document_id:s attempt_count:n extraction_provider:s provider_status:s ingestion_status:s touched:b",
    f"""SELECT document_id,
        CASE WHEN k % 2 = 1 THEN 1 WHEN k % 3 = 0 THEN 2 ELSE 1 + k % 3 END AS attempt_count, 'openai' AS extraction_provider,
        CASE WHEN k % 2 = 1 THEN 'PENDING' WHEN k % 4 <> 0 THEN 'RUNNING' WHEN k % 3 = 0 THEN 'PENDING' END AS provider_status,
        CASE WHEN k % 2 = 1 THEN 'PENDING' ELSE 'UPLOADED' END AS ingestion_status, k % 2 = 1 OR k % 3 = 0 AS touched
      FROM ({A.FANNED}) WHERE error_code IS NULL""",
)
def _(spark, sf_dir):
    fanned = LG.fan_out_documents(A.order_submissions(spark, sf_dir)).filter("error_code is null").withColumn(
        "k", _e("cast(substring(entry_id, 5) as bigint)")
    )
    at = _e("timestamp '2024-01-02 00:00:00'")
    after = LG.upsert_documents(_old_ledger(fanned), fanned, "openai", F.lit("event-1"), at)
    return after.withColumn("touched", F.col("updated_at") == at)


@register(
    "document_transitions", "document_id:s ingestion_status:s file_id:s vector_store_file_id:s openai_status:s error_code:s completed:b step:s",
    """SELECT document_id, coalesce(status, 'PENDING') AS ingestion_status, file_id, store AS vector_store_file_id, os AS openai_status, error_code, completed,
         CASE WHEN coalesce(status, '') = 'COMPLETED' THEN 'skip' WHEN file_id IS NULL THEN 'upload' WHEN store IS NULL THEN 'attach' ELSE 'poll' END AS step
       FROM (SELECT 'doc_' || user_id AS document_id,
           last(CASE event_type WHEN 'signup' THEN 'UPLOADED' WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END
             ORDER BY ts, event_id) FILTER (WHERE event_type <> 'click') AS status,
           last('f' || event_id ORDER BY ts, event_id) FILTER (WHERE event_type = 'signup') AS file_id,
           last('v' || event_id ORDER BY ts, event_id) FILTER (WHERE event_type IN ('view', 'purchase')) AS store,
           last(CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'in_progress' ELSE 'completed' END ORDER BY ts, event_id)
             FILTER (WHERE event_type IN ('signup', 'view', 'purchase')) AS os,
           CASE WHEN last(event_type ORDER BY ts, event_id) FILTER (WHERE event_type <> 'click') = 'error'
             THEN last(CASE WHEN event_id % 3 = 0 THEN 'RATE_LIMIT' ELSE 'UNEXPECTED_ERROR' END ORDER BY ts, event_id) FILTER (WHERE event_type = 'error') END AS error_code,
           bool_or(event_type = 'purchase') AS completed
         FROM events GROUP BY user_id)""",
)
def _(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(
        _e("concat('doc_', user_id)").alias("document_id"), F.col("ts").alias("at"), "event_id",
        _e("case event_type when 'signup' then 'uploaded' when 'view' then 'attached' when 'purchase' then 'completed'"
           " when 'error' then 'failed' else 'noise' end").alias("transition"),
        _e("concat('f', event_id)").alias("file_id"), _e("concat('v', event_id)").alias("vector_store_file_id"),
        _e("case event_type when 'view' then 'in_progress' when 'purchase' then 'completed' end").alias("openai_status"),
        _e("case when event_id % 3 = 0 then 'RATE_LIMIT' else 'bad code' end").alias("error_code"),
        F.lit("1").alias("gcs_generation"), F.lit("application/pdf").alias("source_content_type"),
        F.lit(10).cast("bigint").alias("source_size_bytes"), F.lit("00").alias("source_sha256"),
    )
    pending = A.to_ledger(events.select("document_id").distinct().withColumn("ingestion_status", F.lit("PENDING")).withColumn(
        "updated_at", _e("timestamp '2023-01-01 00:00:00'")
    ))
    return LG.apply_transitions(pending, events).withColumn("completed", F.col("completed_at").isNotNull()).withColumn(
        "step", LG.next_step(F.col("ingestion_status"), F.col("file_id"), F.col("vector_store_file_id"))
    )


@register(
    "provider_locks", "code:s suppliers:n",
    """SELECT CASE WHEN s_suppkey % 10 = 9 THEN 'EXTRACTION_PROVIDER_INVALID' WHEN s_suppkey % 4 = 1 THEN 'EXTRACTION_PROVIDER_RUNTIME_MISMATCH' END AS code,
         count(*) AS suppliers FROM supplier GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(
        LG.provider_lock_error(
            _e("case when s_suppkey % 10 = 9 then 'other' else 'openai' end"),
            _e("case s_suppkey % 4 when 0 then null when 1 then ' llama ' when 2 then ' ' else 'openai' end"),
        ).alias("code")
    )
    return rows.groupBy("code").agg(F.count("*").alias("suppliers"))


@register(
    "latest_submissions", "o_custkey:n o_orderkey:n",
    """SELECT o_custkey, arg_max(o_orderkey, o_orderdate * 1000000000 + o_orderkey) AS o_orderkey FROM (
         SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) AS HUGEINT) AS o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-02')
       GROUP BY o_custkey""",
)
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("entry_id"),
        # The order number breaks ties between submissions of one moment.
        _e("cast(o_orderdate as timestamp) + make_interval(0, 0, 0, 0, 0, 0, o_orderkey / 1000000000)").alias("submitted_at"), "o_orderkey",
    )
    return LG.recent_submission(orders, _e("timestamp '2001-08-01 00:00:00'")).withColumn("o_custkey", F.col("entry_id"))


@register(
    "verified_artifacts", "object_name:s decision:s actual_sha256:s",
    """SELECT 'apps/' || source || '/' || doc_id || '.pdf' AS object_name, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS actual_sha256,
         CASE WHEN doc_id % 7 = 0 THEN 'create' WHEN doc_id % 11 = 0 THEN 'FINAL_GENERATION_INVALID'
              WHEN doc_id % 5 = 0 AND text <> '' THEN 'FINAL_ARTIFACT_MISMATCH' ELSE 'reuse' END AS decision
       FROM documents""",
)
def _(spark, sf_dir):
    return LG.verify_artifacts(*A.final_artifacts(spark, sf_dir))


@register(
    "new_artifacts", "object_name:s",
    "SELECT 'apps/' || source || '/' || doc_id || '.pdf' AS object_name FROM documents WHERE doc_id % 7 = 0",
)
def _(spark, sf_dir):
    return LG.new_artifacts(*A.final_artifacts(spark, sf_dir))


@register(
    "packed_attachments", "entry_id:s error:s kept:l total_bytes:n truncated:b",
    f"""WITH RECURSIVE item AS (SELECT k, i, uri, (k * 7919 * i) % 9000000 AS size FROM ({A.SUBMITTED_FILES})),
      step(k, i, total, kept) AS (
        SELECT o_orderkey, 0, CAST((o_orderkey * 104729) % 30000000 AS BIGINT), CAST([] AS BIGINT[]) FROM orders
        UNION ALL
        SELECT s.k, t.i, CASE WHEN s.total + t.size <= 25165824 THEN s.total + t.size ELSE s.total END,
          CASE WHEN s.total + t.size <= 25165824 THEN list_append(s.kept, t.i) ELSE s.kept END
        FROM step s JOIN item t ON t.k = s.k AND t.i = s.i + 1),
      done AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
      bad AS (SELECT k, count(DISTINCT coalesce(uri, '?')) < count(*) AS repeated FROM item GROUP BY k),
      coded AS (SELECT d.*, CASE WHEN repeated THEN 'BANK_KEYS_INVALID' WHEN (d.k * 104729) % 30000000 > 25165824 THEN 'APPLICATION_PDF_TOO_LARGE' END AS error
        FROM done d LEFT JOIN bad USING (k))
      SELECT 'app_' || k AS entry_id, error, CASE WHEN error IS NULL THEN kept END AS kept, CASE WHEN error IS NULL THEN total END AS total_bytes,
        CASE WHEN error IS NULL THEN len(kept) < k % 6 END AS truncated FROM coded""",
)
def _(spark, sf_dir):
    subs = A.order_submissions(spark, sf_dir)
    sizes = _e("case when o_orderkey % 6 = 0 then cast(array() as array<bigint>) else transform(sequence(1, cast(o_orderkey % 6 as int)), i -> (o_orderkey * 7919 * i) % 9000000) end")
    packed = R.pack_attachments(_e("(o_orderkey * 104729) % 30000000"), sizes, F.col("bank_statement_gcs_keys"))
    return subs.select("entry_id", packed.alias("p")).select("entry_id", "p.*")


# ---- events ---------------------------------------------------------------


@register(
    "validated_ready_events", "event_id:n route:s code:s entry_id:s",
    f"""SELECT event_id, CASE WHEN code IS NOT NULL THEN 'invalid' WHEN relevant THEN 'accepted' ELSE 'irrelevant' END AS route, code, entry_id FROM (
      SELECT event_id, relevant, entry_id, CASE WHEN NOT json_valid(value) THEN 'EVENT_JSON_INVALID' WHEN json_type(j) <> 'OBJECT' THEN 'EVENT_SHAPE_INVALID'
          WHEN relevant AND NOT (len(json_keys(j)) = 8 AND event_key = 'bank_statement_underwriting:' || entry_id || ':v1'
            AND status IN ('READY', 'REVIEW_REQUIRED') AND got = want AND CAST(want AS INT) >= 1) THEN 'EVENT_CONTRACT_INVALID' END AS code
      FROM (SELECT event_id, value, j, coalesce(json_extract_string(j, '$.event_type') = 'bank_statement_underwriting_ready', false) AS relevant,
          json_extract_string(j, '$.entry_id') AS entry_id, json_extract_string(j, '$.event_key') AS event_key, json_extract_string(j, '$.status') AS status,
          json_extract_string(j, '$.expected_document_count') AS want, json_extract_string(j, '$.extracted_document_count') AS got
        FROM (SELECT *, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM ({A.messages_sql(A.READY_MESSAGE)}))))""",
)
def _(spark, sf_dir):
    return EV.validate_ready_events(A.messages(spark, sf_dir, A.READY_MESSAGE)).withColumn("entry_id", F.col("e.entry_id"))


_PDF_CASES = "event_id % 9 IN (0, 7, 8)"


@register(
    "validated_pdf_ready_events", "event_id:n is_valid:b code:s fingerprint:s",
    f"""SELECT event_id, {_PDF_CASES} AS is_valid, CASE WHEN NOT {_PDF_CASES} THEN 'READY_EVENT_INVALID' END AS code,
      CASE WHEN event_id % 9 NOT IN (1, 2, 3) THEN sha256('f' || user_id) END AS fingerprint FROM events""",
)
def _(spark, sf_dir):
    return EV.validate_pdf_ready_events(A.messages(spark, sf_dir, A.PDF_READY_MESSAGE)).withColumn(
        "fingerprint", F.col("e.summary_fingerprint")
    )


@register(
    "delivery_decisions", "event_id:n action:s",
    f"""SELECT event_id, CASE WHEN event_id % 9 = 1 THEN 'drop:PAYLOAD_JSON_INVALID' WHEN event_id % 9 = 4 THEN 'drop:EVENT_TYPE_IRRELEVANT'
        WHEN event_id % 9 = 3 THEN 'drop:ENTRY_ID_INVALID' WHEN event_id % 9 <> 2 AND NOT {_PDF_CASES} THEN 'drop:READY_EVENT_INVALID'
        WHEN c.c_custkey IS NULL THEN 'retry:SUBMISSION_NOT_VISIBLE' WHEN event_id % 9 <> 2 THEN 'ack:FINALIZED'
        WHEN c.c_custkey % 10 = 1 THEN 'retry:PDF_LAYOUT_VERSION_UNSUPPORTED' ELSE 'send' END AS action
      FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 6 <> 5) c ON c.c_custkey = user_id""",
)
def _(spark, sf_dir):
    submissions = read(spark, sf_dir, "customer").filter("c_custkey % 6 <> 5").select(
        _e("concat('c', c_custkey)").alias("entry_id"),
        _e("case when c_custkey % 10 = 1 then 'old' when c_custkey % 2 = 0 then 'underwriting-v1' end").alias("pdf_layout_version"),
    )
    return EV.delivery_decision(A.messages(spark, sf_dir, A.PDF_READY_MESSAGE), submissions)


@from_chain(
    "readiness_events", "entry_id:s event_key:s status:s expected_document_count:n body:s attributes:s",
    """SELECT entry_id, 'bank_statement_underwriting:' || entry_id || ':v1' AS event_key, CASE WHEN review THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS status,
         expected AS expected_document_count,
         '{"event_type":"bank_statement_underwriting_ready","schema_version":1,"analysis_version":1,"event_key":"' || event_key || '","entry_id":"' || entry_id ||
         '","status":"' || status || '","expected_document_count":' || expected || ',"extracted_document_count":' || arrived || '}' AS body,
         '{"event_type":"bank_statement_underwriting_ready","schema_version":"1"}' AS attributes
       FROM sub WHERE whole AND NOT ends_with(entry_id, '7')""",
)
def _(u):
    emitted = u.submission_summary.filter("entry_id like '%7'").select(
        F.concat(F.lit("bank_statement_underwriting:"), "entry_id", F.lit(":v1")).alias("event_key")
    )
    events = EV.readiness_events(u.submission_summary, emitted)
    messages = EV.event_messages(events).withColumnsRenamed({"key": "event_key", "value": "body"}).withColumn("attributes", F.to_json("attributes"))
    return events.join(messages, "event_key")


def _report(u):
    return R.report_statements(u.statement_summary, u.calculated)


@from_chain(
    "validated_summaries", "entry_id:s errors:l",
    """SELECT entry_id, [x FOR x IN [
         CASE WHEN n % 4 = 0 OR (SELECT count(*) FROM graded g WHERE g.entry_id = s.entry_id) < 0 THEN 'SUMMARY_EVENT_MISMATCH' END,
         CASE WHEN rows <> arrived THEN 'SUMMARY_STATEMENT_COUNT_MISMATCH' END,
         CASE WHEN NOT review AND bad THEN 'SUMMARY_STATEMENT_INVALID' END] IF x IS NOT NULL] AS errors
       FROM (SELECT s.*, CAST(substr(entry_id, 7) AS BIGINT) AS n,
           (SELECT count(*) FROM graded g WHERE g.entry_id = s.entry_id) AS rows,
           (SELECT coalesce(bool_or(total_deposits IS NULL OR negative_days IS NULL OR calc_debits IS NULL), false) FROM graded g WHERE g.entry_id = s.entry_id) AS bad
         FROM sub s WHERE whole) s""",
)
def _(u):
    number = F.substring("entry_id", 7, 20).cast("bigint")
    summaries = u.submission_summary.select(
        "entry_id", "analysis_version", "analysis_status", "expected_document_count", "extracted_document_count", "all_documents_processed",
        F.when(number % 4 == 0, "other").otherwise("underwriting-v1").alias("pdf_layout_version"), F.lit("17").alias("pdf_source_generation"),
        F.sha2("entry_id", 256).alias("pdf_source_sha256"), F.sha2(F.lit("x"), 256).alias("summary_fingerprint"), F.lit("gs://a/b/c.pdf").alias("pdf_gcs_key"),
    )
    return EV.validate_summaries(summaries, _report(u), EV.readiness_events(u.submission_summary))


# ---- reports --------------------------------------------------------------

_REPORT = """SELECT entry_id, document_id, document_index, file_id, right(regexp_replace(coalesce(account_number, ''), '[^0-9]', '', 'g'), 4) AS digits,
    CASE WHEN length(digits) = 4 THEN digits END AS account_last_four, CAST(start_date AS VARCHAR) AS statement_start_date, CAST(end_date AS VARCHAR) AS statement_end_date,
    CAST(CAST(total_deposits AS DECIMAL(28,2)) AS VARCHAR) AS deposits, num_credits AS deposit_count, CAST(CAST(true_deposits AS DECIMAL(28,2)) AS VARCHAR) AS true_revenue,
    CAST(CAST(calc_debits AS DECIMAL(28,2)) AS VARCHAR) AS withdrawals, negative_days AS negative_ending_days, adb_text, true_deposits,
    CASE WHEN confirmed_n > 0 THEN 'Yes' WHEN list_contains(reasons, 'MCA_CANDIDATE_UNCONFIRMED') THEN 'Review' ELSE '—' END AS mca_detected,
    CASE WHEN len(reasons) = 0 THEN 'READY' ELSE 'REVIEW_REQUIRED' END AS quality_status FROM graded"""


@from_chain(
    "report_statements",
    "entry_id:s file_id:s account_last_four:s statement_start_date:s statement_end_date:s deposits:s deposit_count:n true_revenue:s withdrawals:s "
    "negative_ending_days:n mca_detected:s quality_status:s",
    _REPORT,
)
def _(u):
    return _report(u)


@from_chain(
    "report_lines", "file_id:s heading:s money_line:s detected:s review:b",
    f"""SELECT file_id, strftime(CAST(statement_start_date AS DATE), '%b %-d, %Y') || '–' || strftime(CAST(statement_end_date AS DATE), '%b %-d, %Y')
          || ' | Account ' || coalesce('**** ' || account_last_four, '—') AS heading,
        'Deposits: ' || coalesce('$' || format('{{:,.2f}}', CAST(deposits AS DOUBLE)), '—') || ' | Deposit count: ' || deposit_count ||
        ' | True revenue: ' || coalesce(CASE WHEN true_deposits < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs(CAST(true_revenue AS DOUBLE))), '—') ||
        ' | Withdrawals: ' || coalesce('$' || format('{{:,.2f}}', CAST(withdrawals AS DOUBLE)), '—') AS money_line,
        CASE WHEN mca_detected = 'Yes' THEN 'Yes' WHEN mca_detected = 'Review' OR quality_status = 'REVIEW_REQUIRED' THEN 'Review' ELSE '—' END AS detected,
        detected = 'Review' AS review
      FROM ({_REPORT})""",
)
def _(u):
    return R.report_lines(_report(u)).withColumn("detected", F.regexp_extract("balance_line", "MCA detected: (.*)$", 1))


@register(
    "report_metadata", "entry_id:s analysis_status:s pdf_gcs_key:s source_rows:n",
    chained("""SELECT entry_id, CASE WHEN NOT whole THEN 'PROCESSING' WHEN review THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS analysis_status,
      'gs://files/' || c_custkey || '.pdf' AS pdf_gcs_key, 1 AS source_rows FROM sub JOIN customer ON entry_id = 'entry_' || c_custkey"""),
)
def _(spark, sf_dir):
    u = chain(spark, sf_dir)
    sources = read(spark, sf_dir, "customer").select(
        _e("concat('entry_', c_custkey)").alias("entry_id"), _e("concat('gs://files/', c_custkey, '.pdf')").alias("pdf_gcs_key"),
        F.lit("underwriting-v1").alias("pdf_layout_version"), F.lit("1").alias("pdf_source_generation"), F.sha2("c_name", 256).alias("pdf_source_sha256"),
    )
    return R.report_metadata(u.submission_summary, sources)


def _json(*pairs: str) -> str:
    """SQL text of a JSON object from ``name kind`` pairs."""
    parts = []
    for pair in pairs:
        name, kind = pair.split()
        value = f"CAST({name} AS VARCHAR)" if kind == "n" else f"'\"' || {name} || '\"'"
        parts.append(f"'\"{name}\":' || coalesce({value}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_LINE_JSON = _json(
    "document_id s", "document_index n", "file_id s", "account_last_four s", "statement_start_date s", "statement_end_date s", "deposits s",
    "deposit_count n", "true_revenue s", "withdrawals s", "negative_ending_days n", "average_daily_balance s", "mca_detected s", "quality_status s",
)
_HEAD_JSON = _json(
    "entry_id s", "analysis_version n", "analysis_status s", "expected_document_count n", "extracted_document_count n", "all_documents_processed n",
)


_PLAIN = ", ".join(f"rtrim(rtrim({c}, '0'), '.') AS {c}" for c in ("deposits", "true_revenue", "withdrawals"))


@from_chain(
    "summary_fingerprints", "entry_id:s summary_fingerprint:s",
    f"""SELECT entry_id, sha256(rtrim({_HEAD_JSON}, '}}') || ',"statements":[' || coalesce(body, '') || ']}}') AS summary_fingerprint FROM (
          SELECT entry_id, 1 AS analysis_version, CASE WHEN NOT whole THEN 'PROCESSING' WHEN review THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS analysis_status,
            expected AS expected_document_count, arrived AS extracted_document_count, whole AS all_documents_processed FROM sub)
        LEFT JOIN (SELECT entry_id, string_agg({_LINE_JSON}, ',' ORDER BY statement_start_date NULLS FIRST, statement_end_date NULLS FIRST, document_index NULLS FIRST, document_id NULLS FIRST) AS body
          FROM (SELECT * REPLACE ({_PLAIN}), adb_text AS average_daily_balance FROM ({_REPORT})) GROUP BY entry_id) USING (entry_id)""",
)
def _(u):
    return R.summary_fingerprints(u.submission_summary, _report(u))


@from_chain(
    "report_rows_in_order", "row:n place:n entry_id:s file_id:s average_daily_balance:s",
    f"""SELECT row_number() OVER (ORDER BY {{}}) AS row, row_number() OVER (PARTITION BY entry_id ORDER BY {{}}) AS place, entry_id, file_id, adb_text AS average_daily_balance
        FROM ({_REPORT})""".format(*["entry_id, statement_start_date NULLS FIRST, statement_end_date NULLS FIRST, document_index, document_id, file_id"] * 2),
)
def _(u):
    return R.rows_in_order(_report(u)).withColumn("average_daily_balance", R.plain_number(F.col("average_daily_balance")))


# ---- web ------------------------------------------------------------------

_PARAMS = f"""
  SELECT *, CASE WHEN event_type = 'signup' THEN 'rep' || k % 5 END AS app,
    CASE WHEN event_type = 'purchase' THEN 's' || k END AS utm_source, CASE WHEN event_type = 'purchase' THEN 'm' || k % 4 END AS utm_medium,
    CASE WHEN event_type = 'signup' THEN 'c' || k || ' x' END AS utm_campaign, CASE WHEN event_type = 'click' THEN 't' || k % 7 END AS utm_term,
    event_type IN ('purchase', 'signup', 'click') AS explicit
  FROM ({A.VISITS})"""


ATTRIBUTION = f"""WITH p AS ({_PARAMS}),
      e AS (SELECT *, coalesce(ts >= lag(ts) OVER o + INTERVAL 30 DAY, true) AS lapsed FROM p WHERE explicit WINDOW o AS (PARTITION BY visitor_id ORDER BY ts, visit_id)),
      r AS (SELECT *, sum(CAST(lapsed AS INT)) OVER (PARTITION BY visitor_id ORDER BY ts, visit_id) AS record FROM e),
      f AS (SELECT visitor_id, visit_id, ts, last_value(app IGNORE NULLS) OVER w AS app, last_value(utm_source IGNORE NULLS) OVER w AS utm_source,
          last_value(utm_medium IGNORE NULLS) OVER w AS utm_medium, last_value(utm_campaign IGNORE NULLS) OVER w AS utm_campaign, last_value(utm_term IGNORE NULLS) OVER w AS utm_term
        FROM r WINDOW w AS (PARTITION BY visitor_id, record ORDER BY ts, visit_id ROWS UNBOUNDED PRECEDING)),
      b AS (SELECT p.visitor_id, p.visit_id, p.explicit, p.ts, last_value(f.visit_id IGNORE NULLS) OVER (PARTITION BY p.visitor_id ORDER BY p.ts, p.visit_id ROWS UNBOUNDED PRECEDING) AS source
        FROM p LEFT JOIN f USING (visitor_id, visit_id))
      SELECT b.visitor_id, b.visit_id, CASE WHEN b.explicit THEN 'url' WHEN f.visit_id IS NOT NULL THEN 'stored' ELSE 'none' END AS origin,
        f.app, f.utm_source, f.utm_medium, f.utm_campaign, f.utm_term
      FROM b LEFT JOIN f ON f.visitor_id = b.visitor_id AND f.visit_id = b.source AND b.ts < f.ts + INTERVAL 30 DAY"""


@register(
    "resolved_attribution", "visitor_id:n visit_id:n origin:s app:s utm_source:s utm_medium:s utm_campaign:s utm_term:s",
    ATTRIBUTION,
)
def _(spark, sf_dir):
    return W.resolve_attribution(A.visits(spark, sf_dir).select("visitor_id", "visit_id", "ts", "url"))


@register(
    "prefill_fields",
    "c:n contact_name:s contact_phone:s federal_tax_id:s amount:s month:s year:s street:s state:s zip:s owner_dob:s",
    """SELECT c, coalesce(nullif(array_to_string([x FOR x IN [CASE WHEN c % 6 <> 0 THEN 'Ann' END, CASE WHEN c % 4 <> 0 THEN 'Lee' || c END] IF x IS NOT NULL], ' '), ''), 'Full Name') AS contact_name,
         '(' || substr(p, 1, 3) || ') ' || substr(p, 4, 3) || '-' || substr(p, 7, 4) AS contact_phone,
         CASE WHEN c % 5 <> 0 THEN substr(e, 1, 2) || '-' || substr(e, 3, 7) END AS federal_tax_id, CASE WHEN c > 0 THEN (c * 100) || '000' END AS amount,
         CASE WHEN ok THEN CAST(c % 15 AS VARCHAR) END AS month, CASE WHEN ok THEN CAST(1915 + c % 110 AS VARCHAR) END AS year,
         c || ' Main' AS street, CASE WHEN c % 3 = 0 THEN 'NY' ELSE '' END AS state, CAST(10000 + c % 90000 AS VARCHAR) AS zip,
         CASE WHEN TRY_CAST(d AS DATE) IS NOT NULL AND 1900 + c % 120 BETWEEN 1910 AND 2010 THEN d END AS owner_dob
       FROM (SELECT c_custkey AS c, CAST(5550000000 + c_custkey * 37 AS VARCHAR) AS p, c_custkey || '123456789' AS e,
         c_custkey % 15 BETWEEN 1 AND 12 AND 1915 + c_custkey % 110 BETWEEN 1920 AND 2024 AS ok, (1900 + c_custkey % 120) || '-02-' || (20 + c_custkey % 11) AS d FROM customer)""",
)
def _(spark, sf_dir):
    filled = W.prefill_fields(A.links(spark, sf_dir), last_year=F.lit(2024))
    return filled.withColumnsRenamed({
        "requested_funding_amount": "amount", "business_started_month": "month", "business_started_year": "year",
    }).select("*", "physical_address.*")


@register(
    "scrubbed_links", "c:n clean_url:s",
    """SELECT c_custkey AS c, 'https://apply.example.com/start?utm_source=mail&page=2&page=' || c_custkey % 4 || CASE WHEN c_custkey % 7 = 0 THEN '#part' ELSE '' END AS clean_url
       FROM customer""",
)
def _(spark, sf_dir):
    return W.scrub_urls(A.links(spark, sf_dir))


@register(
    "captured_underwriting", "session_id:s open_mca:s avg_balance:s",
    f"""SELECT CAST(visitor_id AS VARCHAR) AS session_id, CAST(last(k ORDER BY ts, visit_id) FILTER (WHERE event_type = 'click') AS VARCHAR) AS open_mca,
          CAST(NULL AS VARCHAR) AS avg_balance FROM ({A.VISITS}) GROUP BY visitor_id""",
)
def _(spark, sf_dir):
    return W.captured_underwriting(A.visits(spark, sf_dir).withColumn("session_id", F.col("visitor_id").cast("string")))


_STEP_NAMES = "['contact_information', 'business_information', 'ownership_details', 'bank_statements', 'sign_and_submit']"
_KEPT = f"SELECT *, {_STEP_NAMES}[step_number] AS step_name FROM ({A.JOURNEY}) WHERE event <> 'debug'"
_FIRST = f"""SELECT * FROM ({_KEPT}) QUALIFY event NOT IN ('application_landing', 'application_start', 'application_step_view')
  OR row_number() OVER (PARTITION BY session_id, event, step_number ORDER BY ts, event_id) = 1"""


@register(
    "journey_events", "event_id:n session_id:s event:s step_number:n step_name:s error_category:s app_param:s attribution_utm_source:s", _KEPT,
)
def _(spark, sf_dir):
    return W.journey_events(A.journey(spark, sf_dir))


@register("first_journey_events", "event_id:n session_id:s event:s step_number:n app_param:s", _FIRST)
def _(spark, sf_dir):
    return W.first_events(W.journey_events(A.journey(spark, sf_dir)))


@register(
    "journey_funnel", "stage:n event:s step_number:n sessions:n events:n share:x",
    f"""SELECT stage, event, step_number, count(DISTINCT session_id) AS sessions, count(*) AS events,
          round(count(DISTINCT session_id) / (max(CASE WHEN stage = 0 THEN count(DISTINCT session_id) END) OVER ()), 4) AS share
        FROM (SELECT *, CASE event WHEN 'application_landing' THEN 0 WHEN 'application_start' THEN 1 WHEN 'application_step_view' THEN step_number * 2
            WHEN 'application_step_complete' THEN step_number * 2 + 1 WHEN 'application_submit_attempt' THEN 12 WHEN 'generate_lead' THEN 13 END AS stage
          FROM (SELECT * REPLACE (CASE WHEN event = 'application_submit_attempt' OR event = 'generate_lead' THEN NULL ELSE step_number END AS step_number) FROM ({_FIRST})))
        WHERE stage IS NOT NULL GROUP BY stage, event, step_number""",
)
def _(spark, sf_dir):
    first = W.first_events(W.journey_events(A.journey(spark, sf_dir)))
    step = F.when(~F.col("event").isin("application_submit_attempt", "generate_lead"), F.col("step_number"))
    return W.funnel(first.withColumn("step_number", step))


@register(
    "submit_error_categories", "category:s events:n",
    """SELECT CASE WHEN event_type = 'signup' THEN 'network' WHEN event_type = 'error' THEN 'http' WHEN k % 5 = 0 THEN 'unknown' WHEN k % 5 = 1 THEN 'backend' END AS category, count(*) AS events
       FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) GROUP BY 1""",
)
def _(spark, sf_dir):
    tried = read(spark, sf_dir, "events").withColumn("k", _e("cast(regexp_extract(props, '([0-9]+)', 1) as int)")).select(
        W.submit_error(
            F.col("event_type") != "error", _e("case k % 5 when 0 then null when 1 then false else true end"), F.col("event_type") == "signup"
        ).alias("category")
    )
    return tried.groupBy("category").agg(F.count("*").alias("events"))


@register(
    "resume_events", "event_id:n",
    """SELECT event_id FROM (SELECT event_id, event_type IN ('error', 'view') AS hidden,
         lag(event_type IN ('error', 'view')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE NOT hidden AND before""",
)
def _(spark, sf_dir):
    seen = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts",
        _e("case when event_type in ('error', 'view') then 'hidden' else 'visible' end").alias("state"),
    )
    return W.resume_events(seen)


# ---- text -----------------------------------------------------------------


@register(
    "document_chunks", "doc_id:n chunk_index:n token_count:n chunk:s",
    """SELECT doc_id, i AS chunk_index, len(words) AS token_count, array_to_string(words, ' ') AS chunk FROM (
         SELECT doc_id, i, tokens[i * 400 + 1 : i * 400 + 800] AS words FROM (
           SELECT doc_id, tokens, unnest(range(0, 1 + greatest(len(tokens) - 400 - 1, 0) // 400)) AS i FROM (
             SELECT doc_id, [t FOR t IN regexp_split_to_array(text, '\\s+') IF t <> ''] AS tokens FROM documents) WHERE len(tokens) > 0))""",
)
def _(spark, sf_dir):
    return LG.chunk_documents(read(spark, sf_dir, "documents"), "doc_id", "text")


@register(
    "page_digests", "page_id:n digest:s accepted:b",
    """SELECT page_id, sha256(regexp_replace(html, 'page=[0-9]+', 'page=#', 'g')) AS digest, page_id % 2 = 0 AND digest IS NOT NULL AS accepted FROM pages""",
)
def _(spark, sf_dir):
    digest = T.page_digest(F.col("html"), "page=[0-9]+", "page=#")
    return read(spark, sf_dir, "pages").select("page_id", digest.alias("digest"), (F.col("page_id") % 2 == 0).alias("accepted"))


@register(
    "printable_documents", "doc_id:n shown:s",
    """SELECT doc_id, sha256(trim(regexp_replace(replace(translate(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '‘’“”', '''''""'), '…', '...'),
         '[^\\x20-\\x7e–—]', '?', 'g'))) AS shown FROM documents""",
)
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.printable(F.col("text")), 256).alias("shown"))


@register("folded_documents", "doc_id:n words:n digest:s", None)
def _(spark, sf_dir):
    normal = T.normalize_description(F.col("text"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.size(F.split(normal, " ")).alias("words"), F.sha2(normal, 256).alias("digest")
    )

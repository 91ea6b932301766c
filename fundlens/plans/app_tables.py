"""Submissions, messages, links and artifacts derived from the given tables.

Each derivation uses expressions that other SQL engines share; the matching SQL
stands next to it and feeds the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schemas import LEDGER
from .statement_tables import read

_e = F.expr


def to_ledger(df: DataFrame) -> DataFrame:
    """Fill a partial ledger up to the declared schema."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(LEDGER).fields
        ]
    )


URI_CASES = """CASE WHEN i = 3 AND k % 4 = 0 THEN concat('gs://files/app_', k, '/bank_03.png')
  WHEN i = 4 AND k % 7 = 0 THEN NULL
  WHEN i = 2 AND k % 50 = 0 THEN concat('gs://files/app_', k, '/bank_01.pdf')
  WHEN i = 1 AND k % 61 = 0 THEN 'files/bank_01.pdf'
  WHEN i = 5 THEN concat('gs://files/app_', k, '/bank_05.PDF?v=1')
  ELSE concat('gs://files/app_', k, '/bank_0', i, '.pdf') END"""


def order_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with up to five files, some of them unusable."""
    cases = URI_CASES.replace(" k ", " o_orderkey ").replace(", k,", ", o_orderkey,")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        _e("concat('app_', o_orderkey)").alias("entry_id"),
        F.col("o_orderdate").cast("timestamp").alias("submitted_at"),
        _e(
            "case when o_orderkey % 6 = 0 then cast(array() as array<string>)"
            f" else transform(sequence(1, cast(o_orderkey % 6 as int)), i -> {cases}) end"
        ).alias("bank_statement_gcs_keys"),
    )


SUBMITTED_FILES = f"""
  SELECT k, 'app_' || k AS entry_id, submitted_at, i, {URI_CASES} AS uri
  FROM (SELECT o_orderkey AS k, o_orderdate AS submitted_at, unnest(range(1, 1 + o_orderkey % 6)) AS i FROM orders)"""

FANNED = f"""
  SELECT *, CASE WHEN count(DISTINCT uri) OVER (PARTITION BY k) < count(*) OVER (PARTITION BY k) THEN 'DUPLICATE_GCS_URI'
      WHEN NOT bool_and(starts_with(uri, 'gs://')) OVER (PARTITION BY k) THEN 'INVALID_GCS_URI' END AS error_code,
    'doc_' || substr(sha256(entry_id || chr(10) || uri), 1, 32) AS document_id
  FROM ({SUBMITTED_FILES}) WHERE uri IS NOT NULL AND regexp_matches(lower(uri), '\\.pdf([?#].*)?$')"""


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a narrow table over all tasks. Its file is short, so one task reads it, but each row becomes much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def customer_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application payloads as posted, one per customer."""
    base = spread(read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("c"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"),
        F.col("c_mktsegment").alias("segment"), _e("cast(round(c_acctbal) as bigint)").alias("bal"),
    ))
    return base.select(
        "c",
        _e(f"concat({_PAYLOAD_PARTS})").alias("payload"),
        _e("timestamp '2024-02-01 15:30:00'").alias("submitted_at"),
        _e("case when c % 4 = 0 then '' else concat('10.0.', c % 7, '.1, 10.9.9.9') end").alias("forwarded_for"),
        F.lit("192.0.2.1").alias("remote_address"),
        _e("repeat('agent ', cast(c % 120 as int))").alias("user_agent"),
        _e("transform(sequence(1, cast(1 + c % 3 as int)), i -> concat('state ment#', i, '.pdf'))").alias("bank_files"),
    )


# The posted JSON, piece by piece; valid in both engines.
_PAYLOAD_PARTS = """
  '{"appParam":" ', segment, ' ","utm":{"utm_source":"src', n, '","utm_medium":""},',
  '"underwriting":{"avg_monthly_deposits":" ', bal, ' ","open_mca":"', repeat('lender ', cast(c % 100 as int)), '"},',
  '"formData":{"contactName":"', name, '","contactEmail":"', case when c % 9 = 0 then 'nobody' else concat('c', c, '@example.com') end,
  '","businessLegalName":"', name, ' & Sons","physicalAddress":{"street":"', c, ' Main St","city":"Town', n, '","state":"NY","zip":"',
  10000 + c % 90000, '"},"industry":"', case when c % 5 = 0 then 'Other' else 'Retail' end,
  '","stateOfIncorporation":"DE","businessStartedMonth":"', c % 13, '","businessStartedYear":"', 1990 + c % 30,
  '","federalTaxId":"', 10 + c % 90, '-', 1000000 + c, '","businessEntityType":"Partnership","grossAnnualSalesBucket":"',
  case when c % 3 = 0 then 'gt_5m' when c % 3 = 1 then '500k_1m' else 'odd' end,
  '","requestedFundingAmount":"', case when bal % 4 = 0 then '' else cast(bal * 10 as varchar(20)) end,
  '","owner":{"fullName":"Owner ', c, '","ownershipPercentage":"', c % 110, '","ssn":"', 100 + c % 800, '-', 10 + c % 80, '-', 1000 + c % 9000,
  '","dateOfBirth":"', 1950 + c % 50, '-0', 1 + c % 9, '-', 10 + c % 22, '","address":{"street":"', c, ' Home Rd","city":"Town","state":"NJ","zip":"0700', c % 10, '"}},',
  '"signature":"', case when c % 8 = 0 then '' else 'data:image' end, '","extra":{"kept":true},"termsAccepted":', case when c % 10 = 0 then 'false' else 'true' end, '}}'"""

PAYLOADS = f"""
  SELECT *, concat({_PAYLOAD_PARTS}) AS payload, '2024-02-01 15:30:00' AS submitted_at FROM (
    SELECT c_custkey AS c, c_name AS name, c_nationkey AS n, c_mktsegment AS segment, CAST(round(c_acctbal) AS BIGINT) AS bal FROM customer)"""

VISIT_URL = """case event_type
  when 'purchase' then concat('https://apply.example.com/start?utm_source=s', k, '&utm_medium=m', k % 4, '&utm_source=ignored')
  when 'signup' then concat('https://apply.example.com/start?app=rep', k % 5, '&utm_campaign=%20c', k, '+x&email=a%40b.example#top')
  when 'click' then concat('https://apply.example.com/start?utm_source=&utm_term=t', k % 7, '&open_mca=%20', k, '&avg_balance=')
  else 'https://apply.example.com/start' end"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of one landing page, spread over a year."""
    events = read(spark, sf_dir, "events").withColumn("k", _e("cast(regexp_extract(props, '([0-9]+)', 1) as int)"))
    return events.select(
        F.col("user_id").alias("visitor_id"), F.col("event_id").alias("visit_id"),
        _e("timestamp_micros(1704067200000000 + 12 * (unix_micros(cast(ts as timestamp)) - 1704067200000000))").alias("ts"),
        _e(VISIT_URL).alias("url"), "k", "event_type",
    )


VISITS = f"""
  SELECT user_id AS visitor_id, event_id AS visit_id, k, event_type,
    make_timestamp(1704067200000000 + 12 * (epoch_us(ts) - 1704067200000000)) AS ts, {VISIT_URL} AS url
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"""

LINK_PARTS = """
  'https://apply.example.com/start?first_name=', case when c % 6 = 0 then '' else 'Ann' end, '&last_name=', case when c % 4 = 0 then '%20' else concat('Lee', c) end,
  '&full_name=Full+Name', '&utm_source=mail', '&phone=', 5550000000 + c * 37, '&ein=', case when c % 5 = 0 then 'none' else concat(c, '123456789') end,
  '&amount_requested=%24', c * 100, ',000.50', '&start_date=', 1915 + c % 110, '-', lpad(cast(c % 15 as varchar(4)), 2, '0'), case when c % 2 = 0 then '-31' else '' end,
  '&dob=', 1900 + c % 120, '-02-', 20 + c % 11, '&business_street=', c, '+Main', '&business_state=', case when c % 3 = 0 then 'ny' else 'zz' end,
  '&business_zip=', 10000 + c % 90000, '-1234', '&page=2&open_mca=3&page=', c % 4, case when c % 7 = 0 then '#part' else '' end"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))).withColumn("url", _e(f"concat({LINK_PARTS})"))


LINKS = f"SELECT c, concat({LINK_PARTS}) AS url FROM (SELECT c_custkey AS c FROM customer)"

READY_MESSAGE = """case event_id % 8 when 1 then '{"event_type":' when 2 then '[1]' else concat(
  '{"event_type":"', case when event_id % 8 = 3 then 'legacy' else 'bank_statement_underwriting_ready' end,
  '","schema_version":1,"analysis_version":1,"event_key":"bank_statement_underwriting:entry_', user_id, case when event_id % 8 = 6 then ':v2' else ':v1' end,
  '","entry_id":"entry_', user_id, '","status":"', case when event_id % 8 = 7 then 'DONE' when user_id % 2 = 0 then 'READY' else 'REVIEW_REQUIRED' end,
  '","expected_document_count":3,"extracted_document_count":', case when event_id % 8 = 5 then 0 else 3 end,
  case when event_id % 8 = 4 then ',"note":1' else '' end, '}') end"""

PDF_READY_MESSAGE = """case event_id % 9 when 1 then 'not json' when 2 then concat('{"entry_id":"c', user_id, '"}') when 3 then '{"entry_id":"bad id!"}' else concat(
  '{"event_type":"', case when event_id % 9 = 4 then 'other' else 'application_pdf_ready' end,
  '","schema_version":1,"analysis_version":1,"event_key":"application_pdf:c', user_id, ':v1:', lower(digest),
  '","entry_id":"c', user_id, '","status":"READY","summary_fingerprint":"', case when event_id % 2 = 0 then upper(digest) else digest end,
  '","source_generation":"', user_id, '","final_generation":"', case when event_id % 9 = 5 then 'x' else '17' end,
  '","final_pdf_sha256":"', digest, '"', case when event_id % 9 = 6 then ',"extra":1' else '' end, '}') end"""


def messages(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("digest", _e("sha2(concat('f', user_id), 256)"))
    return events.select("event_id", "user_id", _e(text).alias("value"))


def messages_sql(text: str) -> str:
    return f"SELECT event_id, user_id, {text} AS value FROM (SELECT *, sha256('f' || user_id) AS digest FROM events)"


def final_artifacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected artifacts and the stored ones, whose bytes are the documents' text."""
    documents = read(spark, sf_dir, "documents")
    expected = documents.select(
        _e("concat('apps/', source, '/', doc_id, '.pdf')").alias("object_name"),
        _e("concat('entry_', doc_id)").alias("entry_id"), _e("sha2(lang, 256)").alias("fingerprint"),
        _e("cast(doc_id as string)").alias("source_generation"), _e("sha2(source, 256)").alias("source_sha256"),
    )
    stored = documents.filter("doc_id % 7 <> 0").select(
        _e("concat('apps/', source, '/', doc_id, '.pdf')").alias("object_name"),
        _e("case when doc_id % 11 = 0 then 'x1' else '17' end").alias("generation"),
        F.col("text").cast("binary").alias("content"),
        F.lit("underwritten-v1").alias("artifact_type"), _e("concat('entry_', doc_id)").alias("entry_id"),
        _e("sha2(lang, 256)").alias("fingerprint"), _e("cast(doc_id as string)").alias("source_generation"),
        _e("sha2(source, 256)").alias("source_sha256"),
        _e("case when doc_id % 5 = 0 then sha2('', 256) else sha2(text, 256) end").alias("final_sha256"),
    )
    return expected, stored


JOURNEY_EVENT = """case event_type when 'signup' then 'application_landing' when 'click' then 'application_start'
  when 'view' then 'application_step_view' when 'purchase' then case when k > 90 then 'generate_lead' else 'application_step_complete' end
  else case when k % 3 = 0 then 'application_submit_attempt' when k % 50 = 7 then 'debug' else 'application_validation_error' end end"""


def journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("k", _e("cast(regexp_extract(props, '([0-9]+)', 1) as int)"))
    return events.select(
        _e("concat('s', user_id, '_', dayofmonth(ts))").alias("session_id"), "event_id", "ts",
        _e(JOURNEY_EVENT).alias("event"),
        _e("case when event_type in ('view', 'purchase') then 1 + k % 6 end").alias("step_number"),
        _e("case when event_type = 'error' then case when k % 4 = 0 then 'Bad Value!' else 'invalid_email' end end").alias("error_category"),
        _e("concat('rep', k % 5)").alias("app"), _e("case when k % 2 = 0 then concat('s', k) end").alias("utm_source"),
    )


JOURNEY = f"""
  SELECT 's' || user_id || '_' || day(ts) AS session_id, event_id, ts, {JOURNEY_EVENT} AS event,
    CASE WHEN event_type IN ('view', 'purchase') THEN 1 + k % 6 END AS raw_step,
    CASE WHEN raw_step BETWEEN 1 AND 5 THEN raw_step END AS step_number,
    CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN 'invalid_email' END AS error_category,
    'rep' || k % 5 AS app_param, CASE WHEN k % 2 = 0 THEN 's' || k END AS attribution_utm_source
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"""

"""Registered queries over written tables: constraints, layout, schema changes, scans of stored files, SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sql import register_functions
from ..operators import intake, ledger as LG
from ..sources import checked as C
from ..sources.artifacts import FolderStore, create_artifacts
from ..sources.calendar import Calendar, calendar_violations
from ..sources.rules import rule_violations
from ..sources.sinks import append_by_date, evolve
from ..session import Staging
from . import app_tables as A
from .app_queries import _PAYLOAD_FIELDS
from .app_tables import read
from .replay_queries import folder
from .statement_queries import from_chain, register

_e = F.expr

# ---- contracts of the reference tables ---------------------------------------

_RULE_ROWS = """CAST(2 AS BIGINT) AS analysis_version,
  concat('r', CASE WHEN p_partkey % 41 = 0 THEN p_partkey + 1 ELSE p_partkey END) AS rule_id,
  CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE CAST(p_size - 3 AS BIGINT) END AS priority, true AS active,
  CASE WHEN p_partkey % 7 = 0 THEN 'GUESS' WHEN p_partkey % 2 = 0 THEN 'PREFIX' ELSE 'CONTAINS' END AS match_type,
  CASE WHEN p_partkey % 53 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN p_brand ELSE upper(p_name) END AS match_value,
  CASE WHEN p_partkey % 11 = 0 THEN 'BOTH' ELSE 'DEBIT' END AS direction,
  CASE WHEN p_partkey % 13 = 0 THEN p_type ELSE 'TRANSFER' END AS classification,
  CASE WHEN p_partkey % 17 = 0 THEN 'SURE' ELSE 'CANDIDATE' END AS confidence, p_brand AS canonical_counterparty"""


@register(
    "rule_contract", "rule_id:s violation:s",
    f"""WITH r AS (SELECT {_RULE_ROWS} FROM part)
      SELECT rule_id, unnest([x FOR x IN [
        CASE WHEN priority IS NULL THEN 'MISSING_VALUE' END,
        CASE WHEN match_type = 'GUESS' THEN 'BAD_MATCH_TYPE' END, CASE WHEN direction = 'BOTH' THEN 'BAD_DIRECTION' END,
        CASE WHEN classification <> 'TRANSFER' THEN 'BAD_CLASSIFICATION' END, CASE WHEN confidence = 'SURE' THEN 'BAD_CONFIDENCE' END,
        CASE WHEN priority < 0 THEN 'NEGATIVE_PRIORITY' END,
        CASE WHEN match_value = '' OR match_value <> trim(regexp_replace(upper(match_value), '[^A-Z0-9]+', ' ', 'g')) THEN 'MATCH_VALUE_NOT_NORMALISED' END
      ] IF x IS NOT NULL]) AS violation FROM r
      UNION ALL SELECT rule_id, 'DUPLICATE_RULE' FROM r GROUP BY rule_id HAVING count(*) > 1""",
)
def _(spark, sf_dir):
    return rule_violations(read(spark, sf_dir, "part").selectExpr(*_columns(_RULE_ROWS)))


def _columns(text: str) -> list[str]:
    """The select items of a text that both engines read: cut at the commas outside of brackets."""
    items, depth, start = [], 0, 0
    for at, sign in enumerate(text):
        depth += (sign == "(") - (sign == ")")
        if sign == "," and depth == 0:
            items.append(text[start:at])
            start = at + 1
    return [*items, text[start:]]


_DAY_ROWS = """CAST(o_orderdate AS DATE) AS calendar_date,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE (o_custkey % 4 = 0) <> (o_orderkey % 89 = 0) END AS is_business_day,
  o_custkey % 4 <> 0 AS is_weekend, o_custkey % 4 = 1 AS is_federal_holiday,
  CASE WHEN o_custkey % 4 = 1 AND o_orderkey % 83 <> 0 THEN o_orderpriority END AS holiday_name"""


@register(
    "calendar_contract", "violation:s day:d rows:n",
    f"""WITH d AS (SELECT {_DAY_ROWS} FROM orders)
      SELECT 'INCONSISTENT_FLAGS' AS violation, calendar_date AS day, count(*) AS rows FROM d
      WHERE is_business_day IS NULL OR is_business_day <> (NOT (is_weekend OR is_federal_holiday)) OR is_federal_holiday <> (holiday_name IS NOT NULL)
      GROUP BY ALL
      UNION ALL SELECT 'INCOMPLETE_OR_DUPLICATED', NULL, 1 FROM (SELECT count(*) AS n, count(DISTINCT calendar_date) AS days, min(calendar_date) AS a, max(calendar_date) AS b FROM d)
      WHERE n <> 2557 OR days <> 2557 OR a <> DATE '1995-01-01' OR b <> DATE '2001-12-31'""",
)
def _(spark, sf_dir):
    days = read(spark, sf_dir, "orders").selectExpr(*_columns(_DAY_ROWS))
    found = calendar_violations(days, Calendar(1995, 2001))
    return found.groupBy("violation", F.col("calendar_date").alias("day")).agg(F.count("*").alias("rows"))


# ---- writing ------------------------------------------------------------------

_ORDER_CHECKS = {
    "PRICED": "o_totalprice BETWEEN 1000 AND 400000", "STATUS_KNOWN": "o_orderstatus IN ('O', 'F')",
    "URGENT_ARE_OPEN": "o_orderpriority NOT LIKE '1%' OR o_orderstatus <> 'F'",
}


@register(
    "checked_orders", "attempt:n check_name:s broken:n shown:n",
    f"""WITH o AS (SELECT *, {' AND '.join(f'({c})' for c in _ORDER_CHECKS.values())} AS good FROM orders),
      n AS (SELECT {', '.join(f"count_if(NOT ({c})) AS {name}" for name, c in _ORDER_CHECKS.items())},
        CASE WHEN count(*) = 0 OR min(o_orderkey) <> 0 THEN 1 ELSE 0 END AS STARTS_AT_ZERO, count(*) - count(DISTINCT o_custkey) AS ONE_EACH FROM o)
      SELECT 1 AS attempt, check_name, broken, 0 AS shown FROM (UNPIVOT n ON COLUMNS(*) INTO NAME check_name VALUE broken)
      UNION ALL SELECT 2, 'ALL', 0, count(*) FROM o WHERE good""",
)
def _(spark, sf_dir):
    # All orders break constraints and are not shown; those that meet the row constraints then are.
    at, orders = f"{folder(spark)}/checked", read(spark, sf_dir, "orders")
    rows = {name: _e(c) for name, c in _ORDER_CHECKS.items()}
    every = C.Constraints(rows, {"STARTS_AT_ZERO": F.min("o_orderkey") == 0}, {"ONE_EACH": ["o_custkey"]})
    try:
        C.write_checked(orders, at, every)
        told = {}
    except C.ConstraintFailed as failed:
        told = failed.counts
    good = orders.filter(_e(" AND ".join(f"({c})" for c in _ORDER_CHECKS.values())))
    C.write_checked(good, at, C.Constraints(rows, unique={"KEY": ["o_orderkey"]}))
    first = spark.createDataFrame([(1, name, n, 0) for name, n in told.items()], "attempt int, check_name string, broken long, shown long")
    second = spark.read.parquet(at).agg(F.lit(2).alias("attempt"), F.lit("ALL").alias("check_name"), F.lit(0).cast("bigint").alias("broken"), F.count("*").alias("shown"))
    return first.unionByName(second)


_OLD = "o_orderkey bigint, o_custkey bigint, placed timestamp, cents bigint"


@register(
    "appended_orders", "month:d orders:n cents:n with_priority:n",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents,
         count(o_orderpriority) FILTER (o_orderkey % 3 <> 0) AS with_priority FROM orders GROUP BY 1""",
)
def _(spark, sf_dir):
    # Rows by month, of two writers: the older one does not know the priority, which was added to the table later.
    at = f"{folder(spark)}/appended"
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.date_trunc("month", "o_orderdate").alias("placed"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), "o_orderpriority")
    append_by_date(orders.filter("o_orderkey % 3 = 0").drop("o_orderpriority"), f"{at}/old", _OLD, "placed", ["o_custkey"])
    append_by_date(orders.filter("o_orderkey % 3 <> 0"), f"{at}/new", f"{_OLD}, o_orderpriority string", "placed", ["o_custkey"])
    both = evolve(spark.read.parquet(f"{at}/old"), spark.read.parquet(f"{at}/new"))
    return both.groupBy(F.col("date").alias("month")).agg(
        F.count("*").alias("orders"), F.sum("cents").alias("cents"), F.count("o_orderpriority").alias("with_priority"))


@register(
    "scanned_sources", "page_id:n source_size_bytes:n source_sha256:s valid_pdf_header:b source_content_type:s",
    """SELECT page_id, CAST(strlen(b) AS BIGINT) AS source_size_bytes, sha256(b) AS source_sha256, page_id % 3 <> 1 AND page_id % 3 <> 2 AS valid_pdf_header,
         'application/pdf' AS source_content_type
       FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '%PDF-' WHEN 1 THEN '' ELSE repeat(' ', 1025) || '%PDF-' END || coalesce(html, '') AS b FROM pages)""",
)
def _(spark, sf_dir):
    # Every page is stored as a file; in a third the header comes too late, a third has none.
    at = f"{folder(spark)}/sources"
    head = _e("case page_id % 3 when 0 then '%PDF-' when 1 then '' else concat(repeat(' ', 1025), '%PDF-') end")
    files = read(spark, sf_dir, "pages").select(
        _e("concat('apps/', page_id % 64, '/', page_id, '.pdf')").alias("object_name"), F.concat(head, F.coalesce("html", F.lit(""))).cast("binary").alias("content"),
        F.col("page_id").cast("string").alias("entry_id"), F.lit("1").alias("fingerprint"), F.lit("1").alias("source_generation"), F.lit("1").alias("source_sha256"))
    Staging(spark)(create_artifacts(files, FolderStore(at)), "stored")
    found = LG.scan_source_documents(spark, f"{at}/apps/*", "*.pdf")
    return found.withColumn("page_id", F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("bigint"))


# ---- rows and texts ------------------------------------------------------------


@register(
    "payload_rows", "entry_id:s email:s street:s amount:m app:s extra:s raw_kind:s",
    f"""SELECT entry_id, contact_email AS email, street, amount, CASE WHEN c % 6 <> 0 THEN ' ' || app_param || ' ' END AS app,
         CASE WHEN c % 6 <> 0 THEN 'true' END AS extra, CASE WHEN c % 6 = 0 THEN 'text' ELSE 'object' END AS raw_kind FROM ({_PAYLOAD_FIELDS})""",
)
def _(spark, sf_dir):
    # Every sixth raw payload was cut off and stays text.
    flat = intake.flatten_submissions(A.customer_payloads(spark, sf_dir))
    number = F.regexp_extract("contact_email", r"^c(\d+)@", 1)
    c = F.coalesce(F.nullif(number, F.lit("")), F.regexp_extract("business_physical_street", r"^(\d+)", 1)).cast("bigint")
    cut = flat.withColumn("raw_payload_json", F.when(c % 6 == 0, F.substring("raw_payload_json", 1, 40)).otherwise(F.col("raw_payload_json")))
    body, raw = F.parse_json("body"), F.get_json_object("body", "$.raw_payload")
    return intake.row_payload(cut).select(
        "entry_id", F.try_variant_get(body, "$.submission.contact_email", "string").alias("email"),
        F.try_variant_get(body, "$.submission.business_physical_street", "string").alias("street"),
        F.try_variant_get(body, "$.submission.requested_funding_amount", "decimal(18,2)").alias("amount"),
        F.get_json_object(raw, "$.appParam").alias("app"), F.get_json_object(raw, "$.formData.extra.kept").alias("extra"),
        F.when(F.try_parse_json(raw).isNull(), "text").otherwise("object").alias("raw_kind"))


@register(
    "limited_files", "entry_id:s files:n error_code:s",
    """SELECT 'app_' || o_orderkey AS entry_id, o_orderkey % 6 AS files, CASE WHEN o_orderkey % 6 > 3 THEN 'TOO_MANY_FILES' END AS error_code FROM orders""",
)
def _(spark, sf_dir):
    files = F.col("bank_statement_gcs_keys")
    return A.order_submissions(spark, sf_dir).select("entry_id", F.size(files).alias("files"), intake.files_error(files, 3).alias("error_code"))


@register(
    "redacted_contacts", "c:n email:s phone:s",
    """SELECT c_custkey AS c, CASE WHEN c_custkey % 9 <> 0 THEN '***********' END AS email, CASE WHEN c_custkey % 4 <> 0 THEN '(XXX) XXX-XXXX' END AS phone FROM customer""",
)
def _(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("c"), T.redact_email(_e("case when c_custkey % 9 <> 0 then concat('c', c_custkey, '@example.com') end")).alias("email"),
        T.redact_phone(_e("case when c_custkey % 4 <> 0 then cast(5550000000 + c_custkey as string) end")).alias("phone"))


@register(
    "sql_normalized_lines", "line:s folded:s normal:s",
    """SELECT line, lower(line) AS folded, upper(trim(regexp_replace(line, '[^A-Za-z0-9]+', ' ', 'g'))) AS normal
       FROM (SELECT DISTINCT concat(' ', event_type, ' REF#', user_id, '/', props, '.') AS line FROM events)""",
)
def _(spark, sf_dir):
    register_functions(spark)
    read(spark, sf_dir, "events").selectExpr("concat(' ', event_type, ' REF#', user_id, '/', props, '.') AS line").createOrReplaceTempView("event_lines")
    return spark.sql("SELECT line, fold_text(line) AS folded, normalize_description(line) AS normal FROM (SELECT DISTINCT line FROM event_lines)")


@from_chain(
    "pair_symmetry", "tid:s partner:s mutual:b cancels:b",
    """SELECT a.tid, a.partner, b.partner = a.tid AS mutual, a.amount + b.amount = 0 AND a.is_reversal = b.is_original AS cancels
       FROM classified a JOIN classified b ON b.tid = a.partner""",
)
def _(u):
    ends = u.classified.filter("paired_reversal_transaction_id IS NOT NULL").select(
        F.col("transaction_id").alias("tid"), F.col("paired_reversal_transaction_id").alias("partner"), "amount",
        F.col("is_confirmed_reversal").alias("reverses"), F.col("is_reversed_original").alias("reversed"))
    other = ends.select(F.col("tid").alias("partner"), F.col("partner").alias("back"), F.col("amount").alias("opposite"), F.col("reversed").alias("was_reversed"))
    return ends.join(other, "partner").select(
        "tid", "partner", (F.col("back") == F.col("tid")).alias("mutual"), ((F.col("amount") + F.col("opposite") == 0) & (F.col("reverses") == F.col("was_reversed"))).alias("cancels"))

"""Statements, ledger and submissions derived from the ``events`` table.

The given tables hold no bank statements. Each user becomes a submission, each
ten-day window of a month a statement, each event a transaction. Only arithmetic
and CASE are used, so the same derivation can be written in other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# A statement holds at most this many transactions: a busier user's window is cut
# by event number, so no array outgrows it whatever the skew.


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _e(expression: str):
    return F.expr(expression)


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.to_date("ts").alias("day"),
        _e("cast(regexp_extract(props, '([0-9]+)', 1) as int)").alias("k"),
    )
    windowed = events.withColumn(
        "doc_index",
        _e("cast(3 * ((year(day) - 2024) * 12 + month(day) - 1) + 1 + least(2, cast(floor((day(day) - 1) / 10) as int)) as bigint)"),
    )
    cut = windowed.withColumn("part", F.lit(0).cast("bigint"))  # one statement per user and window, however busy
    pays = (
        "(user_id % 3 = 0 and event_type in ('purchase', 'error', 'view'))"
        " or (user_id % 3 = 1 and event_type in ('purchase', 'error') and dayofweek(day) = 2 + user_id % 5)"
        " or (user_id % 3 = 2 and event_type = 'purchase')"
    )
    lender = (
        "case when user_id % 6 = 3 then 'ACH DEBIT Acme Leasing' when user_id % 3 = 0 then 'Credibly'"
        " when user_id % 3 = 1 then '1st Alliance' else 'National Funding' end"
    )
    lines = cut.withColumn("pays", _e(pays)).withColumn("lender", _e(lender)).withColumn(
        "due", _e("cast(100 + 25 * (user_id % 5) + case when user_id % 4 = 0 and day(day) > 15 then 60 else 0 end as decimal(18,2))")
    )
    return lines.select(
        "event_id", "user_id", "doc_index", "part", "day",
        _e(
            "case when event_id % 991 = 0 then null"
            " when event_id % 983 = 0 then date_sub(day, 40) else day end"
        ).alias("date"),
        _e(
            "case when pays then concat(lender, ' payment REF ', event_id)"
            " when event_type = 'signup' then case"
            "   when k < 5 then 'Internal transfer' when k < 10 then 'Working capital'"
            "   when k < 13 then concat(lender, ' funding') when k < 18 then 'Business loan proceeds'"
            "   when k < 40 then concat('ACH return ', lender) else concat('Customer ', k) end"
            " when event_type = 'click' then case when k = 0 then '' else concat('Customer revenue #', k) end"
            " else concat('Vendor ', substring('ABCDE', 1 + k % 5, 1), ' invoice ', k) end"
        ).alias("description"),
        _e(
            "cast(case when event_id % 997 = 0 then null when pays then -due"
            " when event_type = 'signup' and k between 10 and 12 then 9000 + 10 * k"
            " when event_type = 'signup' and k between 18 and 39 then due"
            " when event_type in ('signup', 'click') then cast(value as decimal(18,2)) * 3"
            " else -cast(value as decimal(18,2)) end as decimal(18,2))"
        ).alias("amount"),
    )


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw extraction rows, with repeated, altered and misbound copies."""
    suffix = "concat(user_id, '_', doc_index, case when part = 0 then '' else concat('_', part) end)"
    grouped = statement_lines(spark, sf_dir).groupBy("user_id", "doc_index", "part").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "date", "description", "amount"))).alias("lines"),
        F.min("day").alias("any_day"),
        _e("cast(coalesce(sum(case when amount > 0 then amount end), 0) as decimal(18,2))").alias("credits"),
        _e("cast(coalesce(sum(case when amount < 0 then -amount end), 0) as decimal(18,2))").alias("debits"),
    )
    base = (
        grouped.withColumn("key", _e(suffix))
        .withColumn("slot", _e("cast(pmod(doc_index - 1, 3) as int)"))
        .withColumn("start_balance", _e("cast(case when user_id % 11 = 0 and slot = 1 then null else 1000 + 10 * (user_id % 50) end as decimal(18,2))"))
        .select(
            _e("concat('entry_', user_id)").alias("entry_id"),
            _e("concat('doc_', key)").alias("document_id"),
            _e("doc_index + part * 1000000").cast("bigint").alias("document_index"),
            _e("concat('file_', key)").alias("file_id"),
            _e("timestamp '2030-03-01 00:00:10'").alias("extracted_at"),
            F.struct(
                F.struct(
                    _e("case when user_id % 9 = 4 then null else concat('ACCT-', user_id) end").alias("account_number"),
                    _e("concat('Bank ', user_id % 3)").alias("bank_name"),
                    _e("concat('Company ', user_id)").alias("company"),
                    "start_balance",
                    _e("cast(case when user_id % 17 = 0 then null else start_balance + credits - debits end as decimal(18,2))").alias("end_balance"),
                    _e("date_add(trunc(any_day, 'MM'), 10 * slot - case when user_id % 10 = 7 and slot = 1 then 3 else 0 end)").alias("statement_start_date"),
                    _e("case when slot = 2 then last_day(any_day) else date_add(trunc(any_day, 'MM'), 10 * slot + 9) end").alias("statement_end_date"),
                    _e("cast(credits + case when user_id % 7 = 0 then 1 else 0 end as decimal(18,2))").alias("total_credits"),
                    _e("cast(debits as decimal(18,2))").alias("total_debits"),
                ).alias("summary"),
                F.transform("lines", lambda t: F.struct(t["date"].alias("date"), t["description"].alias("description"), t["amount"].alias("amount"))).alias("transactions"),
            ).alias("statement"),
            "user_id",
        )
    )
    # Copies: a later one for every 13th user (altered for every 26th), an
    # earlier one bound to another document for every 29th.
    bumped = F.col("statement").withField(
        "summary.start_balance",
        _e("cast(statement.summary.start_balance + case when user_id % 26 = 0 then 100 else 0 end as decimal(18,2))"),
    )
    one, again, misbound = F.lit(0), F.lit(2), F.lit(-1)
    copies = F.array_compact(
        F.array(one, F.when(F.col("user_id") % 13 == 0, again), F.when(F.col("user_id") % 29 == 0, misbound))
    )
    return base.withColumn("shift", F.explode(copies)).select(
        "entry_id",
        F.when(F.col("shift") == -1, F.concat("document_id", F.lit("_x"))).otherwise(F.col("document_id")).alias("document_id"),
        "document_index", "file_id",
        _e("extracted_at + make_interval(0, 0, 0, 0, 0, 0, shift)").alias("extracted_at"),
        F.when(F.col("shift") == 2, bumped).otherwise(F.col("statement")).alias("statement"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One current row per statement, older superseded rows for every 5th user,
    a file that has not arrived and a file of another user for some."""
    keys = statement_lines(spark, sf_dir).select("user_id", "doc_index", "part").distinct()
    suffix = "concat(user_id, '_', doc_index, case when part = 0 then '' else concat('_', part) end)"
    rows = keys.withColumn("key", _e(suffix)).withColumn("slot", _e("cast(pmod(doc_index - 1, 3) as int)")).select(
        _e("concat('entry_', user_id)").alias("entry_id"),
        _e("concat('doc_', key)").alias("document_id"),
        F.lit("bank_statement").alias("document_type"),
        _e("doc_index + part * 1000000").cast("bigint").alias("document_index"),
        _e(
            "case when user_id % 19 = 0 and slot = 2 then null"
            " when user_id % 23 = 5 and slot = 0 then concat('file_', user_id - 1, '_', doc_index)"
            " else concat('file_', key) end"
        ).alias("file_id"),
        F.explode(_e("case when user_id % 5 = 0 then array(0, 1) else array(0) end")).alias("older"),
    )
    return rows.select(
        "entry_id", "document_id", "document_type", "document_index",
        _e("case when older = 1 then concat('old_', file_id) else file_id end").alias("file_id"),
        _e("case when older = 1 then timestamp '2030-03-02 00:00:00' else timestamp '2030-03-03 00:00:00' end").alias("updated_at"),
    )

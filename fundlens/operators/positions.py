"""Recurring financing payments: accounts, epochs, amount streams, cadence,
expected schedule and current status."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import keys as K
from ..sources.calendar import Calendar
from .running import neighbours, numbered_by_index, running_totals
from .selection import exact_medians
from .statements import IDENTITY, with_identity

# Thresholds of the analysis.
AMOUNT_TOLERANCE = "0.01"
AMOUNT_TOLERANCE_FLOOR = 1
DAILY_MIN_DAYS = 4
DAILY_MIN_SHARE = "0.70"
MIN_PAYMENTS = 3
GAPS = {"WEEKLY": (6, 8), "BIWEEKLY": (13, 15), "MONTHLY": (26, 35)}
STEP_DAYS = {"WEEKLY": 7, "BIWEEKLY": 14}
UNKNOWN_LENDER = "Unknown recurring debit"

LENDER = ["entry_id", "account_key", "base_position_key"]
EPOCH = [*LENDER, "funding_epoch"]
# Payment order: days, then statements of a day, then lines of a statement.
LEVELS = ["transaction_date", "document_index"]
TAIL = ["transaction_index", "transaction_id"]


def _valid_period() -> Column:
    return F.col("statement_end_date") >= F.col("statement_start_date")


def within_tolerance(value: Column, base: Column) -> Column:
    margin = F.greatest(
        F.lit(AMOUNT_TOLERANCE_FLOOR).cast("decimal(3,0)"), base * F.lit(AMOUNT_TOLERANCE).cast("decimal(3,2)")
    )
    return F.abs(value - base) <= margin


def account_periods(calculated: DataFrame, current: DataFrame) -> DataFrame:
    """Statement periods of the current documents with their account key.

    Statements without an account number are chained: a period that does not
    start the day after the previous one opens a new chain. The chain number is
    worked out on distinct periods, then spread to their statements.
    """
    periods = with_identity(calculated).select(
        *IDENTITY, "statement_start_date", "statement_end_date", F.col("folded_bank").alias("bank"),
        F.col("folded_company").alias("company"), F.col("folded_account").alias("account"),
    ).join(current.select(*IDENTITY), IDENTITY, "left_semi")

    chainable = (F.col("account") == "") & (F.col("bank") != "") & (F.col("company") != "") & _valid_period()
    owner = ["entry_id", "bank", "company"]
    span = ["statement_start_date", "statement_end_date"]
    in_order = Window.partitionBy(*owner).orderBy(*span)
    distinct_spans = (
        periods.filter(chainable).groupBy(*owner, *span).agg(F.count("*").alias("copies"))
        .withColumn("prior_end", F.lag("statement_end_date").over(in_order))
        .withColumn(
            "opens",
            F.when(F.col("prior_end").isNull(), 1)
            .when(F.datediff("statement_start_date", "prior_end") != 1, 1)
            .otherwise(0),
        )
        .withColumn(
            "first_chain",
            F.sum(F.col("opens") + F.col("copies") - 1).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
            - (F.col("copies") - 1),
        )
        .select(*owner, *span, "first_chain")
    )
    spread = numbered_by_index(
        periods.filter(chainable), [*owner, *span], "document_index", ["document_id", "file_id"], "copy"
    )
    chained = (
        spread.join(distinct_spans, [*owner, *span])
        .withColumn("chain", F.col("first_chain") + F.col("copy") - 1)
        .withColumn("account_key", K.inferred_account_digest(F.col("entry_id"), F.col("bank"), F.col("company"), F.col("chain")))
    )
    others = periods.filter(~F.coalesce(chainable, F.lit(False))).withColumn(
        "account_key",
        F.when(F.col("account") != "", K.account_digest(F.col("entry_id"), F.col("bank"), F.col("account")))
        .otherwise(K.document_digest(F.col("entry_id"), F.col("document_id"))),
    )
    columns = [*IDENTITY, *span, "account_key"]
    return chained.select(*columns).unionByName(others.select(*columns))


def payment_events(classified: DataFrame, periods: DataFrame) -> DataFrame:
    """Confirmed fundings and (known or unknown) payments, keyed by lender."""
    confirmed = F.col("confidence") == "CONFIRMED"
    lender = F.col("canonical_counterparty")
    empty = F.lit(K.EMPTY_TEXT_DIGEST)
    funding = (
        (F.col("amount") > 0) & F.col("paired_reversal_transaction_id").isNull()
        & (F.col("classification") == "MCA_FUNDING") & confirmed & lender.isNotNull()
    )
    known_payment = (F.col("classification") == "MCA_PAYMENT") & confirmed & lender.isNotNull()
    unknown_payment = F.col("classification").isNull() & (F.col("candidate_counterparty_fingerprint") != empty)
    payment = (F.col("amount") < 0) & ~F.col("explicit_reversal_indicator") & (known_payment | unknown_payment)
    known = F.coalesce(
        lender.isNotNull() & F.col("classification").isin("MCA_FUNDING", "MCA_PAYMENT") & confirmed, F.lit(False)
    )
    events = (
        classified.filter(F.col("transaction_date").isNotNull())
        .withColumn("event_type", F.when(funding, "FUNDING").when(payment, "PAYMENT"))
        .filter(F.col("event_type").isNotNull())
        .select(
            *IDENTITY, "transaction_id", "transaction_index", "transaction_date", "event_type",
            F.abs("amount").alias("payment_amount"),
            F.when(known, F.concat(F.lit("LENDER:"), lender))
            .otherwise(F.concat(F.lit("UNKNOWN:"), F.col("candidate_counterparty_fingerprint")))
            .alias("base_position_key"),
            F.when(known, lender).otherwise(F.lit(UNKNOWN_LENDER)).alias("canonical_lender"),
            known.alias("known_lender"),
            (~F.col("is_reversed_payment")).alias("successful"),
        )
    )
    return events.join(periods.select(*IDENTITY, "account_key"), IDENTITY)


def funding_epochs(events: DataFrame) -> DataFrame:
    """Every event with the number of fundings up to it.

    ``payment_number`` counts the lender's successful payments up to the event.
    """
    payment = (F.col("event_type") == "PAYMENT") & F.col("successful")
    return running_totals(
        events, LENDER, LEVELS, TAIL,
        {"funding_epoch": F.col("event_type") == "FUNDING", "payment_number": payment},
    )


def epoch_payments(epochs: DataFrame) -> DataFrame:
    """Payments with the date of the funding that ends their epoch."""
    funding = F.col("event_type") == "FUNDING"
    ends = epochs.filter(funding).select(
        *LENDER, (F.col("funding_epoch") - 1).alias("funding_epoch"),
        F.col("transaction_date").alias("next_funding_date"),
    )
    return epochs.filter(~funding).join(ends, EPOCH, "left")


def stream_openings(payments: DataFrame) -> DataFrame:
    """Marks successful payments that open a new amount stream: they differ from
    the payment before and the next two, all in the same epoch, stay with them."""
    tracked = payments.filter("successful").withColumn("here", F.struct("funding_epoch", "payment_amount"))
    looked = neighbours(
        tracked, LENDER, "payment_number",
        {"previous": ("here", -1), "following": ("here", 1), "second": ("here", 2)},
    )

    def amount_of(name):
        return F.when(F.col(f"{name}.funding_epoch") == F.col("funding_epoch"), F.col(f"{name}.payment_amount"))

    amount = F.col("payment_amount")
    opens = (
        ~within_tolerance(amount, amount_of("previous"))
        & within_tolerance(amount_of("following"), amount)
        & within_tolerance(amount_of("second"), amount)
    )
    marked = looked.withColumn("opens", F.coalesce(opens, F.lit(False))).drop("here", "previous", "following", "second")
    reversed_payments = payments.filter(~F.col("successful")).withColumn("opens", F.lit(False))
    return marked.unionByName(reversed_payments).drop("payment_number")


def amount_streams(openings: DataFrame) -> DataFrame:
    """Numbers the streams of an epoch; a reversed payment takes the stream it
    falls into. Stream and epoch together identify a position."""
    position = K.position_digest(
        F.col("account_key"), F.col("base_position_key"), F.col("funding_epoch"), F.col("amount_stream")
    )
    return (
        running_totals(openings, EPOCH, LEVELS, TAIL, {"amount_stream": F.col("opens")})
        .withColumn("position_key", position)
        .drop("opens")
    )


def representative_amounts(payments: DataFrame) -> DataFrame:
    """Exact decimal median of the successful payments of each position."""
    return exact_medians(payments.filter("successful"), ["entry_id", "position_key"], "payment_amount", "representative_payment_amount")


def with_consistency(payments: DataFrame) -> DataFrame:
    """Payments with their position's median and whether they agree with it."""
    joined = payments.join(representative_amounts(payments), ["entry_id", "position_key"], "left")
    median = F.col("representative_payment_amount")
    return joined.withColumn(
        "is_consistent",
        F.col("successful") & F.coalesce(within_tolerance(F.col("payment_amount"), median), F.lit(False)),
    )


def position_totals(consistent: DataFrame) -> DataFrame:
    """One row per position, from its payments."""
    paid = F.col("successful")
    return consistent.groupBy(*EPOCH, "amount_stream", "position_key").agg(
        F.min("canonical_lender").alias("canonical_lender"),
        F.bool_or("known_lender").alias("known_lender"),
        F.min("next_funding_date").alias("next_funding_date"),
        F.max("representative_payment_amount").alias("representative_payment_amount"),
        F.count_if(paid).alias("successful_payment_count"),
        F.coalesce(F.sum(F.when(paid, F.col("payment_amount"))), F.lit(0)).cast("decimal(28,2)").alias("total_paid"),
        F.min(F.when(paid, F.col("transaction_date"))).alias("first_payment_date"),
        F.max(F.when(paid, F.col("transaction_date"))).alias("last_payment_date"),
        F.count_if(paid & ~F.col("is_consistent")).alias("unresolved_amount_change_count"),
        F.count_if("is_consistent").alias("consistent_payment_count"),
    )


def account_coverage(periods: DataFrame) -> DataFrame:
    return periods.groupBy("entry_id", "account_key").agg(
        F.min("statement_start_date").alias("coverage_start"),
        F.max("statement_end_date").alias("coverage_end"),
    )


def payment_days(consistent: DataFrame, coverage: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Days with consistent payments and their business-day facts, which only
    count inside the account's covered range."""
    days = consistent.filter("is_consistent").groupBy(
        "entry_id", "account_key", "position_key", "transaction_date"
    ).agg(F.count("*").alias("payments"))
    facts = ordinals.withColumnRenamed("calendar_date", "transaction_date")
    inside = F.col("transaction_date").between(F.col("coverage_start"), F.col("coverage_end"))
    return days.join(coverage, ["entry_id", "account_key"]).join(F.broadcast(facts), "transaction_date", "left").select(
        "entry_id", "account_key", "position_key", "transaction_date", "payments",
        F.coalesce(inside & F.col("is_business_day"), F.lit(False)).alias("is_business_day"),
        F.when(inside, F.col("business_day_ordinal")).alias("business_day_ordinal"),
    )


def cadences(totals: DataFrame, days: DataFrame, coverage: DataFrame, ordinals: DataFrame, calendar: Calendar) -> DataFrame:
    """Payment frequency of every position.

    A run of three payments with both gaps in range can only use days whose
    middle day has a single payment (a second one would make a gap of zero), so
    runs are found on payment days instead of payments.
    """
    position = ["entry_id", "position_key"]
    in_order = Window.partitionBy(*position).orderBy("transaction_date")
    spaced = days.select(
        "*",
        F.datediff("transaction_date", F.lag("transaction_date", 1).over(in_order)).alias("gap"),
        F.datediff(F.lag("transaction_date", 1).over(in_order), F.lag("transaction_date", 2).over(in_order)).alias("earlier_gap"),
        F.lag("payments", 1).over(in_order).alias("middle_payments"),
    )

    def run(low, high):
        return F.coalesce(
            F.bool_or((F.col("middle_payments") == 1) & F.col("gap").between(low, high) & F.col("earlier_gap").between(low, high)),
            F.lit(False),
        )

    summary = spaced.groupBy(*position).agg(
        F.count_if("is_business_day").alias("business_payment_days"),
        F.min("transaction_date").alias("first_consistent_date"),
        F.max("transaction_date").alias("last_consistent_date"),
        *[run(*GAPS[name]).alias(f"has_{name}") for name in GAPS],
    )
    joined = totals.join(summary, position, "left").join(coverage, ["entry_id", "account_key"], "left")
    low = calendar.clip_start(F.greatest("first_consistent_date", "coverage_start"))
    high = calendar.clip_end(F.least("last_consistent_date", "coverage_end"))
    known = F.col("coverage_start").isNotNull() & F.col("first_consistent_date").isNotNull()
    bounded = joined.withColumn("span_low", F.when(known, low)).withColumn("span_high", F.when(known, high))
    day, ordinal = F.col("calendar_date"), F.col("business_day_ordinal")
    before_low = ordinals.select(day.alias("span_low"), (ordinal - F.col("is_business_day").cast("int")).alias("before_low"))
    to_high = ordinals.select(day.alias("span_high"), ordinal.alias("to_high"))
    counted = (
        bounded.join(F.broadcast(before_low), "span_low", "left")
        .join(F.broadcast(to_high), "span_high", "left")
        .withColumn(
            "business_days_in_span",
            F.when(F.col("span_low") <= F.col("span_high"), F.col("to_high") - F.col("before_low")).otherwise(F.lit(0)),
        )
    )
    paid_days = F.coalesce("business_payment_days", F.lit(0))
    daily = (paid_days >= DAILY_MIN_DAYS) & (
        F.col("business_days_in_span") > 0
    ) & (paid_days >= F.col("business_days_in_span") * F.lit(DAILY_MIN_SHARE).cast("decimal(3,2)"))
    enough = F.col("consistent_payment_count") >= MIN_PAYMENTS
    frequency = F.when(daily, "BUSINESS_DAILY")
    for name in GAPS:
        frequency = frequency.when(enough & F.col(f"has_{name}"), name)
    return counted.withColumn("frequency", frequency.otherwise("UNCONFIRMED")).drop(
        "span_low", "span_high", "before_low", "to_high", *[f"has_{n}" for n in GAPS]
    )


def position_confidence(cadenced: DataFrame) -> DataFrame:
    """Keeps positions worth reporting and grades them."""
    regular = F.col("frequency") != "UNCONFIRMED"
    confirmed = F.col("known_lender") & (regular | (F.col("funding_epoch") > 0))
    until_funding = F.coalesce(F.date_sub("next_funding_date", 1), F.lit(dt.date(9999, 12, 31)))
    return cadenced.filter(F.col("known_lender") | regular).select(
        "*",
        F.when(confirmed, "CONFIRMED").otherwise("CANDIDATE").alias("position_confidence"),
        ((F.col("unresolved_amount_change_count") > 0) | ~confirmed).alias("position_review_required"),
        F.when(F.col("coverage_end").isNotNull(), F.least("coverage_end", until_funding)).alias("latest_statement_end_date"),
    )


def covered_days(periods: DataFrame, accounts: DataFrame, calendar: Calendar) -> DataFrame:
    """For each account and covered day the document that answers for it."""
    low = calendar.clip_start(F.col("statement_start_date"))
    high = calendar.clip_end(F.col("statement_end_date"))
    spans = periods.join(accounts, ["entry_id", "account_key"], "left_semi").filter(low <= high)
    exploded = spans.select(
        "entry_id", "account_key", F.explode(F.sequence(low, high)).alias("expected_date"),
        F.struct("document_index", "document_id", "file_id").alias("owner"),
    )
    return exploded.groupBy("entry_id", "account_key", "expected_date").agg(F.min("owner").alias("owner"))


def expected_schedule(positions: DataFrame, periods: DataFrame, ordinals: DataFrame, calendar: Calendar) -> DataFrame:
    """Dates on which each regular position should have paid, and the statement
    that covers each. Non-daily dates move to the nearest covered business day."""
    position = ["entry_id", "account_key", "position_key"]
    regular = positions.filter(F.col("frequency") != "UNCONFIRMED").select(
        *position, "frequency",
        F.col("first_consistent_date").alias("first"),
        calendar.clip_start(F.greatest("first_consistent_date", "coverage_start")).alias("low"),
        calendar.clip_end(F.least("latest_statement_end_date", "coverage_end")).alias("high"),
    ).filter(F.col("low") <= F.col("high"))

    # Steps are counted from the first payment, but only those near the covered days are made.
    first, low, high = F.col("first"), F.col("low"), F.col("high")
    steps = F.when(F.col("frequency") == "BUSINESS_DAILY", F.sequence(low, high))
    for name, size in STEP_DAYS.items():
        skipped = F.floor(F.datediff(low, first) / size).cast("int") * size
        begin = F.date_add(first, skipped)
        steps = steps.when(F.col("frequency") == name, F.sequence(begin, F.greatest(begin, high), F.expr(f"interval {size} days")))
    months = F.months_between(high, first), F.months_between(low, first)
    nearby = F.sequence(F.greatest(F.floor(months[1]).cast("int") - 1, F.lit(0)), F.greatest(F.ceil(months[0]).cast("int") + 1, F.lit(0)))
    steps = steps.otherwise(F.transform(nearby, lambda i: F.add_months(first, i)))
    anchors = regular.select("*", F.explode(steps).alias("anchor")).filter(F.col("anchor").between(low, high))

    daily = F.col("frequency") == "BUSINESS_DAILY"
    anchored = anchors.join(
        F.broadcast(
            ordinals.select(
                F.col("calendar_date").alias("anchor"), F.col("business_day_ordinal").alias("anchor_ordinal"),
                F.col("is_business_day").alias("anchor_is_business_day"),
            )
        ),
        "anchor",
    ).filter(~daily | F.col("anchor_is_business_day"))
    reachable = F.when(daily, F.array("anchor_ordinal")).otherwise(
        F.sequence(F.col("anchor_ordinal") - 1, F.col("anchor_ordinal") + 1)
    )
    business_days = ordinals.filter("is_business_day").select(
        F.col("calendar_date").alias("expected_date"), F.col("business_day_ordinal").alias("expected_ordinal")
    )
    candidates = anchored.select(
        *position, "frequency", "anchor", F.explode(reachable).alias("expected_ordinal")
    ).join(F.broadcast(business_days), "expected_ordinal")

    covered = covered_days(periods, regular.select("entry_id", "account_key").distinct(), calendar)
    answered = candidates.join(covered, ["entry_id", "account_key", "expected_date"])
    preference = F.struct(
        F.abs(F.datediff("expected_date", "anchor")), F.col("expected_date") < F.col("anchor"), F.col("expected_date")
    )
    nearest = answered.groupBy(*position, "frequency", "anchor").agg(
        F.min_by(F.struct("expected_date", "expected_ordinal", "owner"), preference).alias("pick")
    )
    return nearest.select(*position, "frequency", "pick.*").groupBy(*position, "frequency", "expected_date").agg(
        F.min("expected_ordinal").alias("expected_ordinal"), F.min("owner").alias("owner")
    ).select(
        *position, "frequency", "expected_date", "expected_ordinal",
        "owner.document_index", "owner.document_id", "owner.file_id",
    )


def match_schedule(expected: DataFrame, days: DataFrame) -> DataFrame:
    """Marks the expected dates that a consistent payment answers: the same day
    for daily positions, one business day around it for the others."""
    daily = F.col("frequency") == "BUSINESS_DAILY"
    frequencies = expected.select("entry_id", "position_key", "frequency").distinct()
    slots = (
        days.join(frequencies, ["entry_id", "position_key"])
        .select(
            "entry_id", "position_key",
            F.explode(
                F.when(daily, F.array(F.datediff("transaction_date", F.lit(dt.date(1970, 1, 1))).cast("bigint")))
                .when(
                    F.col("business_day_ordinal").isNotNull(),
                    F.sequence(F.col("business_day_ordinal") - 1, F.col("business_day_ordinal") + 1),
                )
            ).alias("slot"),
        )
        .distinct()
        .withColumn("matched", F.lit(True))
    )
    slotted = expected.withColumn(
        "slot",
        F.when(daily, F.datediff("expected_date", F.lit(dt.date(1970, 1, 1))).cast("bigint")).otherwise(F.col("expected_ordinal")),
    )
    return slotted.join(slots, ["entry_id", "position_key", "slot"], "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    ).drop("slot")


def status_of(frequency: Column, latest: Column, second: Column, third: Column) -> Column:
    """Status from the last three expected dates; ``latest`` first, NULL if none."""
    return (
        F.when(frequency == "UNCONFIRMED", "CADENCE_UNCONFIRMED")
        .when(latest, "CURRENT_PAYING")
        .when(~latest & (second | third), "CURRENT_WITH_MISSES")
        .when(~latest & ~second, "INACTIVE")
        .otherwise("CADENCE_UNCONFIRMED")
    )


def position_status(positions: DataFrame, schedule: DataFrame) -> DataFrame:
    newest = Window.partitionBy("entry_id", "position_key").orderBy(F.desc("expected_date"))
    last_three = (
        schedule.withColumn("place", F.row_number().over(newest)).filter("place <= 3")
        .groupBy("entry_id", "position_key")
        .agg(*[F.max(F.when(F.col("place") == i, F.col("matched"))).alias(f"match_{i}") for i in (1, 2, 3)])
    )
    status = status_of(F.col("frequency"), F.col("match_1"), F.col("match_2"), F.col("match_3"))
    return positions.join(last_three, ["entry_id", "position_key"], "left").withColumn("status", status).drop(
        "match_1", "match_2", "match_3"
    )


def mca_positions(positions: DataFrame, consistent: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row per position and statement that paid, missed or reversed a payment."""
    where = ["entry_id", "position_key", "document_id", "document_index", "file_id"]
    money = "decimal(28,2)"
    paid = F.col("successful")
    from_payments = consistent.select(
        *where,
        paid.cast("bigint").alias("paid"), F.lit(0).cast("bigint").alias("missed"),
        F.when(paid, F.col("payment_amount")).cast(money).alias("amount"),
        F.when(paid, F.col("transaction_date")).alias("day"),
    )
    from_schedule = schedule.select(
        *where,
        F.lit(0).cast("bigint").alias("paid"), (~F.col("matched")).cast("bigint").alias("missed"),
        F.lit(None).cast(money).alias("amount"), F.lit(None).cast("date").alias("day"),
    )
    per_document = from_payments.unionByName(from_schedule).groupBy(*where).agg(
        F.sum("paid").alias("successful_payment_count"),
        F.sum("missed").alias("missed"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(money).alias("total_paid"),
        F.min("day").alias("first_payment_date"),
        F.max("day").alias("last_payment_date"),
    )
    attributes = positions.select(
        "entry_id", "position_key", "account_key", "canonical_lender", "position_confidence",
        "position_review_required", "status", "frequency",
        F.col("representative_payment_amount").alias("payment_amount"),
    )
    return per_document.join(attributes, ["entry_id", "position_key"]).select(
        "entry_id", "document_id", "document_index", "file_id", "account_key", "position_key",
        "canonical_lender", "position_confidence", "position_review_required", "status",
        "payment_amount", "frequency", "successful_payment_count",
        F.when(F.col("frequency") != "UNCONFIRMED", F.col("missed")).alias("missed_payment_count"),
        "total_paid", "first_payment_date", "last_payment_date",
    )

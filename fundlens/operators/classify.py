"""Rule classification of transactions and pairing of reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import keys as K
from ..functions import text as T
from ..session import Staging
from .statements import IDENTITY

REVERSAL_BUSINESS_DAYS = 5
GRAM = 3


def _rule_tokens(rules: DataFrame, version: int) -> DataFrame:
    """(token, rule) of the active rules of one version, one token each: the whole text of an EXACT
    rule, the first characters of a PREFIX, and of a CONTAINS the trigram that fewest rules hold."""
    value = F.col("match_value")
    active = rules.filter(F.col("active") & (F.col("analysis_version") == version)).select(
        "match_type", "match_value",
        F.struct("priority", "rule_id", "classification", "confidence", "canonical_counterparty",
                 "match_type", "match_value", "direction").alias("rule"),
    )
    grams = F.when(
        F.length(value) >= GRAM,
        F.transform(F.sequence(F.lit(1), F.length(value) - (GRAM - 1)), lambda i: value.substr(i, F.lit(GRAM))),
    ).otherwise(F.array(value))
    held = active.filter(~F.col("match_type").isin("EXACT", "PREFIX")).select(
        "rule", F.explode(F.array_distinct(grams)).alias("gram")
    ).withColumn("holders", F.count("*").over(Window.partitionBy("gram")))
    rarest = held.groupBy("rule").agg(F.min_by("gram", F.struct("holders", "gram")).alias("gram"))
    anchored = active.filter(F.col("match_type").isin("EXACT", "PREFIX")).select(
        F.when(F.col("match_type") == "EXACT", F.concat(F.lit("="), value))
        .otherwise(F.concat(F.lit("^"), value.substr(1, GRAM))).alias("token"),
        "rule",
    )
    return anchored.unionByName(rarest.select(F.concat(F.lit("~"), "gram").alias("token"), "rule"))


def _text_tokens(text: Column) -> Column:
    """All tokens by which a rule can match the text."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    heads = [F.concat(F.lit("^"), text.substr(1, size)) for size in range(1, GRAM + 1)]

    def inside(size):
        return F.transform(places, lambda i: F.concat(F.lit("~"), text.substr(i, F.lit(size))))

    return F.array_distinct(F.concat(F.array(F.concat(F.lit("="), text), F.lit("^"), F.lit("~"), *heads), *map(inside, range(1, GRAM + 1))))


def match_rules(transactions: DataFrame, rules: DataFrame, version: int = 1) -> DataFrame:
    """Adds direction, normalised text and ``rule_matches`` (best rule first).

    Only distinct descriptions are normalised and matched. A description meets a rule by equality of
    a token, then the rule itself is tested; any number of rules goes the same way. The rules' tokens are
    stored first: their size is then known before the join, which need not shuffle the far more tokens of the
    descriptions for a short table. Of a description's tokens only its first and those with a rule that applies go
    on. Transactions take the result by their description, which is the one shuffle of them, and keep the rules
    of their direction.
    """
    spark = transactions.sparkSession
    tokens = Staging(spark)(_rule_tokens(rules, version), "rule_tokens")
    # A description becomes a hundred tokens, so few bytes are much work: they are spread over all tasks again.
    texts = transactions.select("description").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select(
        F.col("description").alias("known_description"),
        T.normalize_description(F.col("description")).alias("normalized_description"),
    )
    text, rule = F.col("normalized_description"), F.col("rule")
    applies = (
        F.when(rule["match_type"] == "EXACT", text == rule["match_value"])
        .when(rule["match_type"] == "PREFIX", F.startswith(text, rule["match_value"]))
        .otherwise(F.contains(text, rule["match_value"]))
    )
    met = texts.select("*", F.posexplode_outer(_text_tokens(text)).alias("place", "token")).join(tokens, "token", "left")
    first = F.coalesce(F.col("place"), F.lit(0)) == 0
    matched = met.filter(first | applies).groupBy("known_description", "normalized_description").agg(
        F.array_sort(F.collect_list(F.when(applies, rule))).alias("text_matches")
    )
    direction = F.col("direction")
    return (
        transactions.join(matched, F.col("description").eqNullSafe(F.col("known_description")), "left")
        .withColumn("direction", F.when(F.col("amount") > 0, "CREDIT").when(F.col("amount") < 0, "DEBIT"))
        .select(
            *[c for c in transactions.columns if c != "description"], "direction", "normalized_description",
            K.transaction_id(F.col("file_id"), F.col("transaction_index")).alias("transaction_id"),
            F.filter(
                "text_matches", lambda r: (r["direction"] == "EITHER") | (r["direction"] == direction)
            ).alias("rule_matches"),
        )
    )


def resolve_matches(matched: DataFrame) -> DataFrame:
    """One classification per transaction from its matching rules."""
    matches = F.col("rule_matches")
    best = F.get(matches, F.lit(0))
    outcomes = F.array_distinct(
        F.transform(
            F.filter(matches, lambda m: m["priority"] == best["priority"]),
            lambda m: F.struct(m["classification"], m["confidence"], m["canonical_counterparty"]),
        )
    )
    conflict = F.col("rule_conflict")
    named = F.filter(matches, lambda m: m["canonical_counterparty"].isNotNull())
    return matched.withColumn("rule_conflict", F.size(outcomes) > 1).select(
        *IDENTITY, "account_key", "transaction_index", "transaction_id", "transaction_date",
        "amount", "balance", "direction",
        F.sha2("normalized_description", 256).alias("description_fingerprint"),
        F.sha2(T.counterparty_words(F.col("normalized_description")), 256).alias(
            "candidate_counterparty_fingerprint"
        ),
        F.transform(matches, lambda m: m["rule_id"]).alias("matched_rule_ids"),
        best["priority"].alias("matched_priority"),
        F.when(conflict, "NON_REVENUE_CANDIDATE").otherwise(best["classification"]).alias("classification"),
        F.when(conflict, "CANDIDATE").otherwise(best["confidence"]).alias("confidence"),
        F.when(~conflict, F.get(named, F.lit(0))["canonical_counterparty"]).alias("canonical_counterparty"),
        "rule_conflict",
        F.exists(
            matches, lambda m: (m["classification"] == "REVERSAL") & (m["confidence"] == "CONFIRMED")
        ).alias("explicit_reversal_indicator"),
    )


def reversal_pairs(resolved: DataFrame, current: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(reversal_transaction_id, original_transaction_id), one to one.

    Each reversal takes the latest earlier original of the same account, lender
    and amount within five business days; when several reversals choose the same
    original the earliest keeps it. No original-by-reversal product is formed:
    originals shrink to the best one per day, and an as-of window over days
    carries it forward.
    """
    keys = ["entry_id", "account_key", "canonical_counterparty", "size"]
    usable = (
        resolved.filter(
            F.col("canonical_counterparty").isNotNull()
            & F.col("amount").isNotNull()
            & F.col("transaction_date").isNotNull()
        )
        .join(current.select(*IDENTITY), IDENTITY, "left_semi")
        .join(
            F.broadcast(ordinals.select(F.col("calendar_date").alias("transaction_date"), "business_day_ordinal")),
            "transaction_date",
        )
    )
    originals = usable.filter(~F.col("explicit_reversal_indicator")).withColumn("size", F.col("amount"))
    reversals = usable.filter("explicit_reversal_indicator").withColumn(
        "size", (-F.col("amount")).cast(resolved.schema["amount"].dataType)
    )
    pick = F.struct("document_index", "transaction_index", "transaction_id", "business_day_ordinal")
    sides = originals.select(
        *keys, "transaction_date", pick.alias("original"), F.lit(None).cast("bigint").alias("reversal_ordinal")
    ).unionByName(
        reversals.select(
            *keys, "transaction_date", F.lit(None).cast(originals.select(pick.alias("p")).schema["p"].dataType).alias("original"),
            F.col("business_day_ordinal").alias("reversal_ordinal"),
        )
    )
    days = sides.groupBy(*keys, "transaction_date").agg(
        F.max("original").alias("original"), F.max("reversal_ordinal").alias("reversal_ordinal")
    )
    so_far = Window.partitionBy(*keys).orderBy("transaction_date").rowsBetween(Window.unboundedPreceding, 0)
    nearest = (
        days.withColumn("original", F.last("original", ignorenulls=True).over(so_far))
        .filter(F.col("reversal_ordinal").isNotNull() & F.col("original").isNotNull())
        .filter(F.col("reversal_ordinal") - F.col("original.business_day_ordinal") <= REVERSAL_BUSINESS_DAYS)
        .select(*keys, "transaction_date", F.col("original.transaction_id").alias("original_transaction_id"))
    )
    chosen = reversals.select(*keys, "transaction_date", "transaction_id").join(nearest, [*keys, "transaction_date"])
    return chosen.groupBy("original_transaction_id").agg(
        F.min_by("transaction_id", F.struct("transaction_date", "transaction_id")).alias("reversal_transaction_id")
    )


def attach_pairs(resolved: DataFrame, pairs: DataFrame) -> DataFrame:
    """Marks both ends of every pair. A transaction is never both a reversal and
    an original, so one join does; only transactions with a known lender can be
    paired, so the others do not take part in its shuffle."""
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("reversal_transaction_id").alias("transaction_id"),
                    F.col("original_transaction_id").alias("partner"),
                    F.lit(True).alias("reverses"),
                ),
                F.struct(
                    F.col("original_transaction_id").alias("transaction_id"),
                    F.col("reversal_transaction_id").alias("partner"),
                    F.lit(False).alias("reverses"),
                ),
            )
        ).alias("end")
    ).select("end.*")
    pairable = F.col("canonical_counterparty").isNotNull()
    reversed_original = F.coalesce(~F.col("reverses"), F.lit(False))
    no = F.lit(False)

    def marked(df, partner, reversal, original, payment):
        return df.select(
            *resolved.columns,
            partner.cast("string").alias("paired_reversal_transaction_id"), reversal.alias("is_confirmed_reversal"),
            original.alias("is_reversed_original"), payment.alias("is_reversed_payment"),
        )

    joined = marked(
        resolved.filter(pairable).join(ends, "transaction_id", "left"),
        F.col("partner"), F.coalesce("reverses", no), reversed_original,
        F.coalesce(reversed_original & (F.col("amount") < 0), no),
    )
    return joined.unionByName(marked(resolved.filter(~pairable), F.lit(None), no, no, no))

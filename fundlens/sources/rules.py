"""The versioned transaction rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schemas import RULES

MATCH_TYPES = ["EXACT", "PREFIX", "CONTAINS"]
DIRECTIONS = ["CREDIT", "DEBIT", "EITHER"]
CLASSIFICATIONS = [
    "MCA_FUNDING", "MCA_PAYMENT", "OTHER_LOAN_PROCEEDS", "TRANSFER", "REVERSAL",
    "NON_REVENUE_CANDIDATE",
]
CONFIDENCES = ["CONFIRMED", "CANDIDATE"]

# Version 1 of the rules. All match by CONTAINS and are active.
# (rule_id, priority, match_value, direction, classification, confidence, counterparty)
RULES_V1 = [
    ("credibly_credit", 10, "CREDIBLY", "CREDIT", "MCA_FUNDING", "CONFIRMED", "Credibly"),
    ("credibly_debit", 10, "CREDIBLY", "DEBIT", "MCA_PAYMENT", "CONFIRMED", "Credibly"),
    ("national_funding_credit", 10, "NATIONAL FUNDING", "CREDIT", "MCA_FUNDING", "CONFIRMED", "National Funding"),
    ("national_funding_debit", 10, "NATIONAL FUNDING", "DEBIT", "MCA_PAYMENT", "CONFIRMED", "National Funding"),
    ("nf1016_credit", 10, "NF1016", "CREDIT", "MCA_FUNDING", "CONFIRMED", "National Funding"),
    ("nf1016_debit", 10, "NF1016", "DEBIT", "MCA_PAYMENT", "CONFIRMED", "National Funding"),
    ("nfas2_credit", 10, "NFAS2", "CREDIT", "MCA_FUNDING", "CONFIRMED", "National Funding"),
    ("nfas2_debit", 10, "NFAS2", "DEBIT", "MCA_PAYMENT", "CONFIRMED", "National Funding"),
    ("cfgms_credit", 10, "CFGMS", "CREDIT", "MCA_FUNDING", "CONFIRMED", "CFG Merchant Solutions"),
    ("cfgms_debit", 10, "CFGMS", "DEBIT", "MCA_PAYMENT", "CONFIRMED", "CFG Merchant Solutions"),
    ("cfg_merchant_credit", 10, "CFG MERCHANT", "CREDIT", "MCA_FUNDING", "CONFIRMED", "CFG Merchant Solutions"),
    ("cfg_merchant_debit", 10, "CFG MERCHANT", "DEBIT", "MCA_PAYMENT", "CONFIRMED", "CFG Merchant Solutions"),
    ("first_alliance_numeric_credit", 10, "1ST ALLIANCE", "CREDIT", "MCA_FUNDING", "CONFIRMED", "1st Alliance"),
    ("first_alliance_numeric_debit", 10, "1ST ALLIANCE", "DEBIT", "MCA_PAYMENT", "CONFIRMED", "1st Alliance"),
    ("first_alliance_word_credit", 10, "FIRST ALLIANCE", "CREDIT", "MCA_FUNDING", "CONFIRMED", "1st Alliance"),
    ("first_alliance_word_debit", 10, "FIRST ALLIANCE", "DEBIT", "MCA_PAYMENT", "CONFIRMED", "1st Alliance"),
    ("business_loan_proceeds_credit", 20, "BUSINESS LOAN PROCEEDS", "CREDIT", "OTHER_LOAN_PROCEEDS", "CONFIRMED", None),
    ("loan_proceeds_credit", 20, "LOAN PROCEEDS", "CREDIT", "OTHER_LOAN_PROCEEDS", "CONFIRMED", None),
    ("reversal_marker", 20, "REVERSAL", "EITHER", "REVERSAL", "CONFIRMED", None),
    ("returned_item_marker", 20, "RETURNED ITEM", "EITHER", "REVERSAL", "CONFIRMED", None),
    ("ach_return_marker", 20, "ACH RETURN", "EITHER", "REVERSAL", "CONFIRMED", None),
    ("transfer_from_savings_credit", 20, "TRANSFER FROM SAVINGS", "CREDIT", "TRANSFER", "CONFIRMED", None),
    ("transfer_from_checking_credit", 20, "TRANSFER FROM CHECKING", "CREDIT", "TRANSFER", "CONFIRMED", None),
    ("internal_transfer_credit", 20, "INTERNAL TRANSFER", "CREDIT", "TRANSFER", "CONFIRMED", None),
    ("broad_transfer_credit_candidate", 100, "TRANSFER", "CREDIT", "NON_REVENUE_CANDIDATE", "CANDIDATE", None),
    ("broad_capital_credit_candidate", 100, "CAPITAL", "CREDIT", "NON_REVENUE_CANDIDATE", "CANDIDATE", None),
    ("broad_funding_credit_candidate", 100, "FUNDING", "CREDIT", "NON_REVENUE_CANDIDATE", "CANDIDATE", None),
    ("broad_advance_credit_candidate", 100, "ADVANCE", "CREDIT", "NON_REVENUE_CANDIDATE", "CANDIDATE", None),
    ("broad_loan_credit_candidate", 100, "LOAN", "CREDIT", "NON_REVENUE_CANDIDATE", "CANDIDATE", None),
]
RULES_V1_COUNT = 29
RULES_V1_DIGEST = "862dcb865b27da66d5a715d80e03681cee4be10ab4071d9bcf9342d33d011706"


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(1, rid, pri, True, "CONTAINS", *rest) for rid, pri, *rest in RULES_V1]
    return spark.createDataFrame(rows, RULES)


def rules_digest(rules: DataFrame, version: int = 1) -> DataFrame:
    """One-row digest of a rule version, independent of row order."""
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("<NULL>"))

    fields = [
        F.when(F.col("active"), "1").otherwise("0") if f.name == "active" else text(f.name)
        for f in StructType.fromDDL(RULES).fields
    ]
    lines = rules.filter(F.col("analysis_version") == version).select(
        "rule_id", F.concat_ws("|", *fields).alias("line")
    )
    ordered = F.array_sort(F.collect_list(F.struct("rule_id", "line")))
    return lines.agg(
        F.count("*").alias("rule_count"),
        F.sha2(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n"), 256).alias("digest"),
    )


def rule_checks() -> dict[str, Column]:
    """Violation code to the condition under which a rule shows it."""
    from ..functions.text import normalize_description

    required = [f.name for f in StructType.fromDDL(RULES).fields if f.name != "canonical_counterparty"]
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    value = F.col("match_value")
    bad = {
        "MISSING_VALUE": missing,
        "BAD_MATCH_TYPE": ~F.col("match_type").isin(MATCH_TYPES),
        "BAD_DIRECTION": ~F.col("direction").isin(DIRECTIONS),
        "BAD_CLASSIFICATION": ~F.col("classification").isin(CLASSIFICATIONS),
        "BAD_CONFIDENCE": ~F.col("confidence").isin(CONFIDENCES),
        "NEGATIVE_PRIORITY": F.col("priority") < 0,
        "MATCH_VALUE_NOT_NORMALISED": (value == "") | (value != normalize_description(value)),
    }
    return {code: F.coalesce(condition, F.lit(False)) for code, condition in bad.items()}


def rule_violations(rules: DataFrame) -> DataFrame:
    """Rules that break the table's contract; empty when it holds."""
    checks = F.array_compact(F.array(*[F.when(bad, code) for code, bad in rule_checks().items()]))
    row_level = rules.select("analysis_version", "rule_id", F.explode(checks).alias("violation"))
    duplicates = (
        rules.groupBy("analysis_version", "rule_id").count().filter("count > 1")
        .select("analysis_version", "rule_id", F.lit("DUPLICATE_RULE").alias("violation"))
    )
    return row_level.unionByName(duplicates)

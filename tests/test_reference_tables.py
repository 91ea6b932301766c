import datetime as dt

from fundlens.sources.calendar import Calendar, calendar_violations
from fundlens.sources.rules import (
    RULES_V1_COUNT, RULES_V1_DIGEST, default_rules, rule_violations, rules_digest,
)


def test_rules_digest(spark):
    rules = default_rules(spark)
    found = rules_digest(rules).first()
    assert (found.rule_count, found.digest) == (RULES_V1_COUNT, RULES_V1_DIGEST)
    assert rule_violations(rules).count() == 0
    broken = rules.union(rules.limit(1)).union(rules.limit(1).replace("CONTAINS", "GUESS", subset=["match_type"]))
    assert {r.violation for r in rule_violations(broken).collect()} == {"DUPLICATE_RULE", "BAD_MATCH_TYPE"}


def test_calendar(spark):
    calendar = Calendar()
    days = calendar.days(spark).cache()
    assert days.count() == 9497
    assert calendar_violations(days, calendar).count() == 0
    by_day = {r.calendar_date: r for r in days.filter("calendar_date between '2021-01-01' and '2027-12-31'").collect()}
    assert by_day[dt.date(2026, 7, 3)].is_business_day
    assert not by_day[dt.date(2027, 7, 5)].is_business_day
    assert by_day[dt.date(2027, 7, 5)].holiday_name == "Independence Day (Observed)"
    assert by_day[dt.date(2026, 1, 19)].holiday_name == "Birthday of Martin Luther King, Jr."
    assert by_day[dt.date(2026, 5, 25)].holiday_name == "Memorial Day"
    assert by_day[dt.date(2026, 11, 26)].holiday_name == "Thanksgiving Day"

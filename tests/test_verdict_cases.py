"""Inputs that the fixtures of the registered queries do not hold."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from fundlens.functions import text as T, urls
from fundlens.operators import events as EV, intake, ledger as LG, reporting, running


def test_fragment_is_not_a_query(spark):
    rows = [("https://x/a#r?first_name=Ann&b=1",), ("https://x/a?first_name=Ann&b=1#r?c=2",), ("https://x/a?v=a%20b%&w=%zz",)]
    df = spark.createDataFrame(rows, "u string")
    clean = [r.c for r in df.select(urls.without_params(F.col("u"), ["first_name"]).alias("c")).collect()]
    assert clean == ["https://x/a#r?first_name=Ann&b=1", "https://x/a?b=1#r?c=2", "https://x/a?v=a%20b%&w=%zz"]
    found = [r.p for r in df.select(urls.pairs(F.col("u")).alias("p")).collect()]
    assert found[0] == [] and [(x.name, x.value) for x in found[2]] == [("v", "a b%"), ("w", "%zz")]


def ready(entry="e1", count="2", key=None):
    event = f'{{"event_type":"{EV.READY_TYPE}","schema_version":1,"analysis_version":1,"event_key":"KEY","entry_id":"{entry}","status":"STATUS",'
    return event + f'"expected_document_count":{count},"extracted_document_count":{count}}}'


def test_ready_event_spellings(spark):
    from fundlens.functions import keys as K

    key = spark.range(1).select(K.ready_event_key(F.lit("e1")).alias("k")).first().k
    good = ready().replace("KEY", key).replace("STATUS", EV.STATUSES[0])
    cases = [good, "\n\t" + good, good.replace(":2", ":2.0"), good.replace(":2", ":2.5"), good.replace(":2", ':"2"'), good.replace('"entry_id":"e1"', '"entry_id":"e1\\n"'), "[1]", "{"]
    found = EV.validate_ready_events(spark.createDataFrame([(c,) for c in cases], "value string")).select("route", "code").collect()
    assert [r.route for r in found] == ["accepted"] * 3 + ["invalid"] * 5
    assert [r.code for r in found[6:]] == ["EVENT_SHAPE_INVALID", "EVENT_JSON_INVALID"]


def test_one_decision_per_message(spark):
    messages = spark.createDataFrame([(1, '{"entry_id":"e1"}')], "n int, value string")
    rows = [("e1", "2024-01-01", "other"), ("e1", "2024-02-01", EV.LAYOUT_VERSION)]
    submissions = spark.createDataFrame(rows, "entry_id string, submitted_at string, pdf_layout_version string")
    assert [r.action for r in EV.delivery_decision(messages, submissions).collect()] == ["send"]


def test_transition_moves_one_submission(spark):
    ledger = spark.createDataFrame(
        [("d", t, None, None, "PENDING", None, None, "2024-01-01", None, None, None, None, None) for t in ("2024-01-01", "2024-02-01")],
        "document_id string, submitted_at string, provider_file_id string, vector_store_file_id string, ingestion_status string, error_code string, "
        "completed_at string, updated_at string, openai_status string, gcs_generation string, source_content_type string, source_size_bytes bigint, source_sha256 string")
    event = spark.createDataFrame(
        [("d", "2024-02-01", "2024-02-02", "1", "completed", "vs", "done", None, None, None, None, None, None)],
        "document_id string, submitted_at string, at string, event_id string, transition string, vector_store_file_id string, openai_status string, "
        "error_code string, gcs_generation string, source_content_type string, source_size_bytes bigint, source_sha256 string, file_id string")
    after = {r.submitted_at: r.ingestion_status for r in LG.apply_transitions(ledger, event).collect()}
    assert after == {"2024-01-01": "PENDING", "2024-02-01": "COMPLETED"}


def test_latest_submission_breaks_ties(spark):
    rows = [("e", "2024-01-01", x) for x in "bca"]
    df = spark.createDataFrame(rows, "entry_id string, submitted_at string, x string")
    seen = {LG.recent_submission(df.repartition(n), F.current_timestamp(), None).first().x for n in (1, 2, 5)}
    assert seen == {"c"}


def test_running_totals_keep_fractions_and_nulls(spark):
    rows = [("k", 1, 1, Decimal("0.60")), ("k", 1, 2, Decimal("0.60")), ("k", None, 1, Decimal("0.25")), (None, 1, 1, Decimal("1.00"))]
    df = spark.createDataFrame(rows, "key string, day int, n int, v decimal(18,2)")
    found = running.running_totals(df, ["key"], ["day"], ["n"], {"total": F.col("v")}).collect()
    assert sorted((str(r.key), str(r.day), r.n, r.total) for r in found) == [
        ("None", "1", 1, Decimal("1.00")), ("k", "1", 1, Decimal("0.85")), ("k", "1", 2, Decimal("1.45")), ("k", "None", 1, Decimal("0.25"))]


def test_too_many_files_are_told(spark):
    df = spark.createDataFrame([(["f"] * 10,), (["f"] * 11,)], "files array<string>")
    assert [r.e for r in df.select(intake.files_error(F.col("files")).alias("e")).collect()] == [None, "TOO_MANY_FILES"]


def test_periods_up_to_the_last_year_stay_few_rows(spark):
    import datetime as dt

    from fundlens.operators import underwriting as U

    last = dt.date(9999, 12, 31)
    columns = (
        "entry_id string, document_id string, document_index bigint, account_number string, bank_name string, company string, "
        "statement_start_date date, statement_end_date date"
    )
    rows = [
        ("far", "d1", 1, "A", "B", "C", dt.date(2024, 1, 1), last), ("far", "d2", 2, "A", "B", "C", last, last),
        ("apart", "d1", 1, "A", "B", "C", dt.date(2024, 1, 1), dt.date(5000, 1, 1)), ("apart", "d2", 2, "A", "B", "C", dt.date(5000, 1, 2), last),
        ("one", "d1", 1, None, "B", "C", dt.date(1, 1, 1), last),
    ]
    statements = spark.createDataFrame(rows, columns)
    assert {r.entry_id for r in U.overlapping_entries(statements).collect()} == {"far"}
    days = U._day_number("statement_start_date"), U._day_number("statement_end_date")
    sizes = statements.select(F.size(U._aligned_blocks(*days)).alias("filled"), F.size(U._blocks_around(*days)).alias("held")).collect()
    assert max(r.filled + r.held for r in sizes) <= 88


def test_monthly_and_weekly_steps_begin_at_the_first_payment(spark):
    import datetime as dt

    from fundlens.operators import positions as P
    from fundlens.sources.calendar import Calendar

    first, low, high = dt.date(2021, 1, 31), dt.date(2023, 2, 1), dt.date(2023, 5, 31)
    names = "entry_id string, account_key string, position_key string, frequency string, first_consistent_date date, coverage_start date, latest_statement_end_date date, coverage_end date"
    positions = spark.createDataFrame([("e", "a", f, f, first, low, high, high) for f in ("MONTHLY", "WEEKLY")], names)
    periods = spark.createDataFrame([("e", "a", low, high, 1, "d", "f")], "entry_id string, account_key string, statement_start_date date, statement_end_date date, document_index int, document_id string, file_id string")
    calendar = Calendar()
    due = P.expected_schedule(positions, periods, calendar.ordinals(spark), calendar).collect()
    monthly = sorted(str(r.expected_date) for r in due if r.position_key == "MONTHLY")
    # The last days of the months, moved to the nearest business day.
    assert monthly == ["2023-02-28", "2023-03-31", "2023-05-01", "2023-05-31"]
    weekly = sorted(r.expected_date for r in due if r.position_key == "WEEKLY")
    assert len(weekly) == sum(1 for i in range(0, 900, 7) if low <= first + dt.timedelta(days=i) <= high)


def test_thousands_of_rules_match_as_plain_tests_do(spark):
    import random

    from fundlens.operators import classify as C
    from fundlens.schemas import RULES

    rng = random.Random(4)
    word = lambda low, high: "".join(rng.choice("ABC 1") for _ in range(rng.randrange(low, high))).strip()
    rules = [(1, f"r{i:04}", rng.randrange(9), rng.random() < 0.9, rng.choice(["EXACT", "PREFIX", "CONTAINS"]), word(1, 8),
              rng.choice(["CREDIT", "DEBIT", "EITHER"]), "TRANSFER", "CONFIRMED", None) for i in range(2001)]
    lines = [("f", i, " ".join(word(0, 12).split()) or None, Decimal(rng.choice([-5, 0, 7]))) for i in range(300)] + [("f", 300, None, None)]
    df = spark.createDataFrame(lines, "file_id string, transaction_index bigint, description string, amount decimal(18,2)")
    found = C.match_rules(df, spark.createDataFrame(rules, RULES)).collect()
    assert len(found) == len(lines)
    tests = {"EXACT": lambda t, v: t == v, "PREFIX": lambda t, v: t.startswith(v), "CONTAINS": lambda t, v: v in t}
    for row in found:
        text = row.normalized_description or ""
        fits = [(r[2], r[1]) for r in rules if r[3] and r[6] in ("EITHER", row.direction) and tests[r[4]](text, r[5])]
        assert [m.rule_id for m in row.rule_matches] == [name for _, name in sorted(fits)], text


def test_numbers_and_kinds_in_pdf_events(spark):
    digest = "ab" * 32

    def message(**changes):
        body = {"event_type": EV.PDF_READY_TYPE, "schema_version": 1, "analysis_version": 1, "event_key": f"application_pdf:e1:v1:{digest}", "entry_id": "e1", "status": "READY",
                "summary_fingerprint": digest.upper(), "source_generation": 7, "final_generation": "17", "final_pdf_sha256": digest}
        return json.dumps({**body, **changes})

    whole = message().replace('"schema_version": 1', '"schema_version":1.0').replace('"source_generation": 7', '"source_generation": 7.0')
    numbered = message(entry_id=7, event_key=f"application_pdf:7:v1:{digest}")
    cases = {message(): True, whole: True, numbered: True, message(schema_version="1"): False, message(schema_version=1.5): False, message(analysis_version=True): False,
             message(more=None): False, message(status=None): False, message(final_generation="x"): False, "[1]": False, "null": False, "{": False, '"text"': False}
    found = EV.validate_pdf_ready_events(spark.createDataFrame([(c,) for c in cases], "value string")).collect()
    assert {r.value: r.is_valid for r in found} == cases
    assert next(r for r in found if r.value == whole).e.source_generation == "7"
    submissions = spark.createDataFrame([("e1", None), ("7", None)], "entry_id string, pdf_layout_version string")
    actions = {
        message(): "ack:FINALIZED", whole: "ack:FINALIZED", numbered: "drop:ENTRY_ID_INVALID", '{"entry_id":7}': "drop:ENTRY_ID_INVALID", '{"entry_id":"e1"}': "send",
        '{"entry_id":"e1","event_type":false}': "send", '{"entry_id":"e1","event_type":0}': "send", '{"entry_id":"e1","event_type":0.0}': "send", '{"entry_id":"e1","event_type":""}': "send",
        '{"entry_id":"e1","event_type":null}': "send", '{"entry_id":"e1","event_type":true}': "drop:EVENT_TYPE_IRRELEVANT", '{"entry_id":"e1","event_type":2}': "drop:EVENT_TYPE_IRRELEVANT",
        '{"entry_id":"e1","event_type":[]}': "drop:EVENT_TYPE_IRRELEVANT", '{"entry_id":"e1","event_type":0.5}': "drop:EVENT_TYPE_IRRELEVANT", "[1]": "drop:ENTRY_ID_INVALID",
        "null": "drop:ENTRY_ID_INVALID", "{": "drop:PAYLOAD_JSON_INVALID", message(status="DONE"): "drop:READY_EVENT_INVALID", '{"entry_id":"e2"}': "retry:SUBMISSION_NOT_VISIBLE"}
    decided = EV.delivery_decision(spark.createDataFrame([(c,) for c in actions], "value string"), submissions).collect()
    assert {r.value: r.action for r in decided} == actions


def test_numbers_are_trimmed_of_all_white_space(spark):
    rows = [("\t12.5\n",), (" 7 ",), ("1\n2",), ("3.\n",)]
    found = spark.createDataFrame(rows, "v string").select(T.exact_decimal(F.col("v")).alias("t")).collect()
    assert [r.t for r in found] == ["$12.50", "$7.00", T.DASH, T.DASH]


def test_recipients_by_configuration_and_by_table(spark):
    rows = spark.createDataFrame([("e1", " Desk "), ("e2", None), ("e3", "k1500"), ("e4", "twice")], "entry_id string, app_param string")
    extras = {"desk": ["d@x", "all@x"], "twice": ["a@x", "b@x"], **{f"k{i}": [f"{i}@x"] for i in range(2000)}}
    want = {"e1": ["all@x", "d@x"], "e2": ["all@x"], "e3": ["all@x", "1500@x"], "e4": ["all@x", "a@x", "b@x"]}
    assert {r.entry_id: r.recipients for r in reporting.route_recipients(rows, ["all@x"], extras).collect()} == want
    table = spark.createDataFrame([("desk", ["d@x", "all@x"]), ("twice", ["b@x"]), ("twice", ["a@x"]), ("k1500", ["1500@x"])], "app_key string, recipients array<string>")
    assert {r.entry_id: r.recipients for r in reporting.route_recipients(rows, ["all@x"], table).collect()} == want
    short = {"desk": extras["desk"]}
    assert {r.entry_id: r.recipients for r in reporting.route_recipients(rows, ["all@x"], short).collect()} == {**want, "e3": ["all@x"], "e4": ["all@x"]}
    message = EV.event_messages(spark.createDataFrame([("k", "t", None)], "event_key string, event_type string, schema_version long")).first()
    assert (message.key, message.attributes) == ("k", {"event_type": "t"})


def test_tokens_of_descriptions_are_not_shuffled_for_a_short_rule_table(spark):
    from fundlens.operators import classify as C
    from fundlens.schemas import RULES

    rules = spark.createDataFrame([
        (1, "r1", 1, True, "CONTAINS", "ACME", "EITHER", "TRANSFER", "CONFIRMED", None),
        (1, "r2", 2, True, "PREFIX", "PAY", "EITHER", "TRANSFER", "CONFIRMED", None)], RULES)
    moves = spark.createDataFrame([("f", 1, "Acme pay"), ("f", 2, "pay acme"), ("f", 3, ""), ("f", 4, None), ("f", 5, "other")], "file_id string, transaction_index long, description string").selectExpr("*", "CAST(1 AS DECIMAL(18,2)) AS amount")
    found = C.match_rules(moves, rules)
    joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "token" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    assert {r.transaction_index: [m.rule_id for m in r.rule_matches] for r in found.collect()} == {1: ["r1"], 2: ["r1", "r2"], 3: [], 4: [], 5: []}

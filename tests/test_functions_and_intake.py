import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fundlens.functions import text as T, urls as L
from fundlens.operators import classify as C, events as EV, intake, ledger as LG, positions as P, reporting as R, underwriting as U, web as W
from fundlens.plans.app_tables import to_ledger
from fundlens.sources import sinks
from fundlens.sources.calendar import Calendar
from fundlens.sources.rules import default_rules
from fundlens.schemas import SUBMISSIONS


def values(spark, items, make):
    """Apply a column function to literal values, in order."""
    df = spark.createDataFrame(list(enumerate(items)), "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("make, cases", [
    (T.normalize_description, {"  Credibly---Funding  ": "CREDIBLY FUNDING", None: "", "ﬁrst ALLIANCE Ｃｏ": "FIRST ALLIANCE CO",
                               "Straße №5": "STRASSE NO5", "Café 12": "CAFÉ 12"}),
    (T.clean, {" 8100 ": "8100", "  ": None, "\t\n": None, "a b": "a b"}),
    (T.slug, {"Smith & Sons, LLC": "smith-and-sons-llc", "": "unknown", None: "unknown", "--A--": "a", "x" * 80: "x" * 60}),
    (T.phone_format, {"55": "(55", "5551": "(555) 1", "1-555-234-5678-99": "(155) 523-4567", "": ""}),
    (T.ssn_format, {"123": "123", "1234": "123-4", "123456789": "123-45-6789"}),
    (T.ein_format, {"12": "12", "123456789": "12-3456789", "1234567890000": "12-3456789", "not-an-ein": ""}),
    (T.usd_format, {"12345": "$12,345", "12.5": "$12.5", "0": "$0", "abc": "", "1200": "$1,200", "1.2.3": ""}),
    (lambda c: T.exact_decimal(c), {"9007199254740993.123456789": "$9,007,199,254,740,993.12", "-0.001": "$0.00", "2.345": "$2.35",
                                    "-2.345": "-$2.35", "1e3": "—", None: "—", "1234567": "$1,234,567.00",
                                    "0.0049999999999": "$0.00", "0.995": "$1.00"}),
    (lambda c: T.exact_decimal(c, scale=0, currency=False), {"1234.5": "1,235", "-7": "-7"}),
    (T.display_date, {"2026-01-05": "Jan 5, 2026", "2026-1-5": "—", "2026-13-01": "—", "x": "—", None: "—"}),
    (T.printable, {"a\tb“c”…é": 'a b"c"...?', None: "", "x–y—z": "x–y—z"}),
    (T.stable_error_code, {"RATE_LIMIT": "RATE_LIMIT", "AB": "UNEXPECTED_ERROR", "bad": "UNEXPECTED_ERROR", None: "UNEXPECTED_ERROR"}),
    (T.first_hop, {"1.2.3.4, 5.6.7.8": "1.2.3.4", "": None, None: None}),
    (T.finite_number, {"12.5": 12.5, "": None, "abc": None, "NaN": None, "Infinity": None, " 7 ": 7.0}),
    (W.whole_dollars, {"200000.00": "200000", "$200,000.50": "200000", "none": None, "0": None, "007": "7"}),
    (lambda c: F.concat_ws("/", W.business_start(c, F.lit(2026))["month"], W.business_start(c, F.lit(2026))["year"]),
     {"2014-07-28": "7/2014", "2014-12": "12/2014", "2014-13-01": "", "1919-01-01": "", "2014": ""}),
    (W.birth_date, {"1949-08-18": "1949-08-18", "2010-12-31": "2010-12-31", "2011-01-01": None, "1949-02-30": None, "1949-8-18": None}),
    (lambda c: F.concat_ws("|", *L.bucket_and_object(c)), {"gs://b/x/y.pdf": "b|x/y.pdf", "s3://b/x": "", "gs://b/": ""}),
    (L.folder, {"a/b/c.pdf": "a/b", "c.pdf": None}),
    (T.redact_phone, {"5": "(XXX) XXX-XXXX", None: None}),
])
def test_text_functions(spark, make, cases):
    assert values(spark, list(cases), make) == list(cases.values())


def test_display_period_and_eastern_time(spark):
    row = spark.range(1).select(
        T.display_period(F.lit("2026-01-01"), F.lit("2026-01-31")).alias("p"),
        T.eastern(F.lit("2026-07-01 03:30:00").cast("timestamp"), "M/d/yyyy h:mm a").alias("e"),
        T.safe_filename(F.lit("my:file?.pdf"), F.lit(3)).alias("f"), T.safe_filename(F.lit(None).cast("string"), F.lit(12)).alias("g"),
        T.page_digest(F.lit("Page 3 of 9"), r"Page \d+ of \d+", "Page # of #").alias("d"), F.sha2(F.lit("Page # of #"), 256).alias("w"),
    ).first()
    assert row.p == "Jan 1, 2026–Jan 31, 2026"
    assert row.e == "6/30/2026 11:30 PM"
    assert (row.f, row.g) == ("bank_03_my_file_.pdf", "bank_12_statement_12")
    assert row.d == row.w


def classify(spark, lines):
    df = spark.createDataFrame(
        [("e", "d", 1, "f", "k", i + 1, dt.date(2026, 1, 2), text, Decimal(str(amount)), None) for i, (text, amount) in enumerate(lines)],
        "entry_id string, document_id string, document_index bigint, file_id string, account_key string, transaction_index bigint, "
        "transaction_date date, description string, amount decimal(18,2), balance decimal(28,2)",
    )
    extra = [(1, "x_prefix", 10, True, "PREFIX", "ACME", "DEBIT", "MCA_PAYMENT", "CONFIRMED", "Acme"),
             (1, "x_exact", 10, True, "EXACT", "ACME CREDIBLY", "DEBIT", "TRANSFER", "CONFIRMED", None),
             (1, "x_off", 1, False, "CONTAINS", "ACME", "EITHER", "REVERSAL", "CONFIRMED", None)]
    rules = default_rules(spark).union(spark.createDataFrame(extra, default_rules(spark).schema))
    return C.resolve_matches(C.match_rules(df, rules)).orderBy("transaction_index").collect()


def test_rule_winners(spark):
    found = classify(spark, [
        ("Credibly funding", 100), ("Internal transfer", 5), ("Working capital", 5), ("Customer", 5), ("Acme Credibly", -5),
        ("ACH DEBIT EXAMPLE REF 123456", -1), ("ACH DEBIT EXAMPLE TRACE 999999", -1), ("ACH return Credibly", 7), ("acme x", -1),
    ])
    assert [(r.classification, r.confidence) for r in found[:4]] == [
        ("MCA_FUNDING", "CONFIRMED"), ("TRANSFER", "CONFIRMED"), ("NON_REVENUE_CANDIDATE", "CANDIDATE"), (None, None)]
    conflict = found[4]
    assert conflict.rule_conflict and conflict.classification == "NON_REVENUE_CANDIDATE" and conflict.canonical_counterparty is None
    assert found[5].candidate_counterparty_fingerprint == found[6].candidate_counterparty_fingerprint
    assert found[7].explicit_reversal_indicator and found[7].canonical_counterparty == "Credibly"
    assert found[7].classification == "MCA_FUNDING"
    assert found[8].matched_rule_ids == ["x_prefix"]


def test_position_status_table(spark):
    cases = [(True, False, False, "CURRENT_PAYING"), (False, True, False, "CURRENT_WITH_MISSES"), (False, False, True, "CURRENT_WITH_MISSES"),
             (False, False, False, "INACTIVE"), (False, None, None, "CADENCE_UNCONFIRMED"), (None, None, None, "CADENCE_UNCONFIRMED")]
    df = spark.createDataFrame(cases, "a boolean, b boolean, c boolean, want string")
    got = df.select("want", P.status_of(F.lit("WEEKLY"), F.col("a"), F.col("b"), F.col("c")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_withholding_and_tolerance(spark):
    money = lambda v: F.lit(v).cast("decimal(18,2)")
    row = spark.range(1).select(
        U.withholding(money("333"), money("10000")).alias("a"), U.withholding(money("1"), money("0")).alias("b"),
        U.withholding(money("1"), money("-5")).alias("c"), P.within_tolerance(money("101"), money("100")).alias("d"),
        P.within_tolerance(money("101.01"), money("100")).alias("e"), P.within_tolerance(money("1010"), money("1000")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (Decimal("3.33"), None, None, True, False, True)


def test_daily_balances_of_three_days(spark):
    d = lambda n: dt.date(2026, 1, n)
    df = spark.createDataFrame(
        [("e", "d", "f", Decimal(100), d(1), d(3), [(d(1), "x", Decimal(-150), Decimal(-50)), (d(3), "y", Decimal(100), Decimal(50))])],
        "entry_id string, document_id string, file_id string, start_balance decimal(18,2), statement_start_date date, statement_end_date date, "
        "transactions array<struct<date: date, description: string, amount: decimal(18,2), known_balance: decimal(28,2)>>",
    )
    assert [r.closing_balance for r in U.daily_closing_balances(df, Calendar()).orderBy("calendar_date").collect()] == [-50, -50, 50]
    row = U.with_balance_metrics(df, Calendar()).first()
    assert (row.calendar_day_count, row.negative_balance_days, round(row.average_daily_balance, 2)) == (3, 2, Decimal("-16.67"))


def test_amount_streams_with_a_reversed_payment(spark):
    amounts = [100, 120, 120, 120, 100, 100, 100]
    rows = [("e", "a", "L", f"t{i}", i, dt.date(2026, 1, 1) + dt.timedelta(days=4 * i), Decimal(v), True, "PAYMENT") for i, v in enumerate(amounts)]
    rows.append(("e", "a", "L", "rev", 99, dt.date(2026, 1, 27), Decimal(100), False, "PAYMENT"))
    df = spark.createDataFrame(
        rows, "entry_id string, account_key string, base_position_key string, transaction_id string, transaction_index bigint, "
              "transaction_date date, payment_amount decimal(18,2), successful boolean, event_type string",
    ).withColumn("document_index", F.lit(1).cast("bigint"))
    streams = P.amount_streams(P.stream_openings(P.epoch_payments(P.funding_epochs(df))))
    found = {r.transaction_id: r.amount_stream for r in streams.collect()}
    assert [found[f"t{i}"] for i in range(7)] == [0, 1, 1, 1, 2, 2, 2] and found["rev"] == 2


def test_payload_without_signature(spark):
    payload = {"appParam": "r", "formData": {"signature": "s", "contactName": "n", "odd": {"deep": [1, {"x": None}]}}, "list": [1, 2]}
    df = spark.createDataFrame([(json.dumps(payload),), ("[1]",), ('{"formData":3}',), ('"text"',)], "p string")
    got = [r.c for r in df.select(intake.sanitize_payload(F.col("p")).alias("c")).collect()]
    del payload["formData"]["signature"]
    assert json.loads(got[0]) == payload
    assert got[1:] == ["[1]", '{"formData":3}', '"text"']


def test_fan_out(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at, ["gs://b/bank_01.pdf", "gs://b/bank_02.png", None, "gs://b/X.PDF?v=2"]), ("dup", at, ["gs://b/1.pdf"] * 2),
            ("bad", at, ["b/1.pdf"]), ("none", at, None), ("", at, ["gs://b/1.pdf"])]
    df = spark.createDataFrame(rows, "entry_id string, submitted_at timestamp, bank_statement_gcs_keys array<string>")
    found = LG.fan_out_documents(df).collect()
    good = sorted((r.document_index, r.gcs_uri) for r in found if r.error_code is None)
    assert good == [(1, "gs://b/bank_01.pdf"), (4, "gs://b/X.PDF?v=2")]
    assert all(len(r.document_id) == 36 and r.document_id.startswith("doc_") for r in found if r.error_code is None)
    assert sorted((r.entry_id, r.error_code) for r in found if r.error_code) == [
        ("", "INVALID_SUBMISSION_ROW"), ("bad", "INVALID_GCS_URI"), ("dup", "DUPLICATE_GCS_URI")]


def test_upsert_twice_changes_nothing(spark):
    at = F.lit("2024-01-05").cast("timestamp")
    updates = spark.createDataFrame([("d1", "e", dt.datetime(2024, 1, 1), "bank_statement", 1, "gs://b/1.pdf")],
                                    "document_id string, entry_id string, submitted_at timestamp, document_type string, document_index bigint, gcs_uri string")
    empty = to_ledger(updates).limit(0)
    once = LG.upsert_documents(empty, updates, "openai", F.lit("v"), at)
    twice = LG.upsert_documents(once, updates, "openai", F.lit("w"), at)
    assert once.collect() == twice.collect() and once.first().attempt_count == 1


def test_ready_event_routes(spark):
    good = {"event_type": EV.READY_TYPE, "schema_version": 1, "analysis_version": 1, "event_key": "bank_statement_underwriting:e:v1",
            "entry_id": "e", "status": "READY", "expected_document_count": 2, "extracted_document_count": 2}
    cases = [(good, "accepted"), ({**good, "x": 1}, "invalid"), ({**good, "extracted_document_count": 0}, "invalid"),
             ({**good, "expected_document_count": 2.5}, "invalid"), ({k: v for k, v in good.items() if k != "status"}, "invalid"),
             ({"event_type": "legacy"}, "irrelevant"), ({**good, "schema_version": 2}, "irrelevant")]
    rows = [(json.dumps(m), want) for m, want in cases] + [("{", "invalid"), ("[]", "invalid"), ("3", "invalid")]
    df = spark.createDataFrame(rows, "value string, want string")
    assert [(r.route, r.value) for r in EV.validate_ready_events(df).collect()] == [(w, v) for v, w in rows]


def test_summary_validation(spark):
    status = [("ok", "READY", 1), ("empty", "READY", 1), ("noid", "READY", 1), ("dup", "READY", 2), ("text", "READY", 1), ("soft", "REVIEW_REQUIRED", 1)]
    events = spark.createDataFrame([(e, s, n, n) for e, s, n in status], "entry_id string, status string, expected_document_count bigint, extracted_document_count bigint")
    sha = "a" * 64
    summaries = spark.createDataFrame([(e, 1, s, n, n, True, "underwriting-v1", "17", sha, sha, "gs://b/x.pdf") for e, s, n in status],
        "entry_id string, analysis_version bigint, analysis_status string, expected_document_count bigint, extracted_document_count bigint, "
        "all_documents_processed boolean, pdf_layout_version string, pdf_source_generation string, pdf_source_sha256 string, summary_fingerprint string, pdf_gcs_key string")
    line = lambda e, d, f, deposits="9007199254740993.123456789": (e, d, f, "1234", "2026-01-01", "2026-01-31", deposits, 1, "1.00", "0", 0, "1.5", "Yes", "READY")
    rows = [line("ok", "d", "f"), line("noid", None, "f2"), line("dup", "d1", "same"), line("dup", "d2", "same"), line("text", "d", "f3", "1e3"), line("soft", "d", "f4", None)]
    statements = spark.createDataFrame(rows, "entry_id string, document_id string, file_id string, account_last_four string, statement_start_date string, "
        "statement_end_date string, deposits string, deposit_count bigint, true_revenue string, withdrawals string, negative_ending_days bigint, "
        "average_daily_balance string, mca_detected string, quality_status string")
    found = {r.entry_id: r.errors for r in EV.validate_summaries(summaries, statements, events).collect()}
    assert found == {"ok": [], "soft": [], "empty": ["SUMMARY_STATEMENT_COUNT_MISMATCH"], "noid": ["SUMMARY_DOCUMENT_BINDING_INVALID"],
                     "dup": ["SUMMARY_DOCUMENT_BINDING_INVALID"], "text": ["SUMMARY_STATEMENT_INVALID"]}


def test_attachments_pass_over_what_does_not_fit(spark):
    df = spark.createDataFrame([(10, [50, 60, 30], ["a", "b", "c"]), (200, [1], ["a"]), (1, [1, 1], ["a", "a"])], "n bigint, sizes array<bigint>, uris array<string>")
    got = [r.p for r in df.select(R.pack_attachments(F.col("n"), F.col("sizes"), F.col("uris"), budget=100).alias("p")).collect()]
    assert (got[0].kept, got[0].total_bytes, got[0].truncated) == ([1, 3], 90, True)
    assert [got[1].error, got[2].error] == ["APPLICATION_PDF_TOO_LARGE", "BANK_KEYS_INVALID"]


def test_source_scan_and_artifacts(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"\x00" * 1024 + b"%PDF-1.7 body")
    (tmp_path / "late.pdf").write_bytes(b"\x00" * 1025 + b"%PDF-1.7 body")
    found = {r.path.rsplit("/", 1)[1]: r for r in LG.scan_source_documents(spark, str(tmp_path)).collect()}
    assert found["good.pdf"].valid_pdf_header and not found["late.pdf"].valid_pdf_header
    import hashlib
    assert found["good.pdf"].source_sha256 == hashlib.sha256((tmp_path / "good.pdf").read_bytes()).hexdigest()
    name = spark.range(1).select(LG.final_object_name(F.lit("a/b/x.pdf"), F.lit("e"), F.lit("ff")).alias("n")).first().n
    assert name == "a/b/e_underwritten_v1_ff.pdf"


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("e1", dt.datetime(2024, 1, 1, 5)), ("e2", dt.datetime(2024, 1, 2))], "entry_id string, submitted_at timestamp")
    path = str(tmp_path / "subs")
    sinks.append_by_date(old, path, SUBMISSIONS, "submitted_at", ["entry_id"])
    sinks.append_by_date(old.limit(1), path, SUBMISSIONS, "submitted_at", ["entry_id"])
    back = spark.read.parquet(path)
    assert back.count() == 3 and back.filter("date = '2024-01-02'").count() == 1
    with pytest.raises(sinks.SchemaMismatch):
        sinks.conform(old.withColumn("surprise", F.lit(1)), SUBMISSIONS)
    assert sinks.evolve(old, old.withColumn("added", F.lit(1))).count() == 4


def test_files_hold_ranges_that_readers_skip(spark, tmp_path):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=0 if i % 3 else i % 30)  # one day holds two thirds
    rows = [(f"e{i * 7919 % 20_000:05}", day(i)) for i in range(20_000)]
    table = spark.createDataFrame(rows, "entry_id string, submitted_at timestamp").repartition(16)
    path = tmp_path / "subs"
    sinks.append_by_date(table, str(path), SUBMISSIONS, "submitted_at", ["entry_id"], rows_per_file=2_000)
    files = list(path.rglob("part-*.parquet"))
    dates = len({d.name for d in path.iterdir() if d.name.startswith("date=")})
    assert len(files) <= 20_000 / 2_000 + dates + 2 and dates == 10  # not tasks x dates
    assert max(spark.read.parquet(str(path)).groupBy(F.input_file_name()).count().toPandas()["count"]) < 2 * 2_000
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = spark.read.parquet(str(path)).filter("date = '2024-01-01' AND entry_id = 'e07919'")
        frame = found._jdf.queryExecution()
        assert len(frame.executedPlan().executeCollect()) == 1
        read = frame.executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert read <= 2 * 2_000  # of some 14,000 rows of that day: the other files' row groups are skipped
    assert spark.read.parquet(str(path)).count() == 20_000


def test_amounts_that_do_not_fit_are_rejected(spark):
    def posted(key, amount="1.25", balance="10"):
        names = ["account_number", "bank_name", "company", "start_balance", "end_balance", "statement_start_date", "statement_end_date", "total_credits", "total_debits"]
        summary = ",".join(f'"{n}":{balance if n == "end_balance" else "null"}' for n in names)
        lines = f'[{{"date":"2024-01-01","description":"x","amount":{amount}}},{{"date":null,"description":null,"amount":null}}]'
        return (f'{{"entry_id":"e","document_id":"{key}","document_index":1,"file_id":"f","extracted_at":"2024-01-02T00:00:00Z","statement":{{"summary":{{{summary}}},"transactions":{lines}}}}}',)

    good = {"whole": ("7", "10"), "cents": ("-1.25", "0.10"), "zeros": ("1.2500", "3.000"), "text": ('"4.5"', '"6"'), "long": ("9999999999999999.99", "-9999999999999999.99"),
            "null": ("null", "null")}
    bad = {"sub_cent": ("0.005", "1"), "tiny": ("1.0000000001", "1"), "too_long": ("123456789012345678901234567890.12", "1"), "seventeen": ("10000000000000000", "1"),
           "word": ('"abc"', "1"), "balance": ("1", "2.001"), "long_balance": ("1", "99999999999999999"), "word_balance": ("1", '"n/a"')}
    rows = [posted(k, *v) for k, v in {**good, **bad}.items()]
    kept, refused = intake.parse_extractions(spark.createDataFrame(rows, "value string"))
    assert sorted(r.document_id for r in kept.collect()) == sorted(good)
    assert sorted(json.loads(r.value)["document_id"] for r in refused.collect()) == sorted(bad)
    amounts = {r.document_id: r.statement.transactions[0].amount for r in kept.collect()}
    assert str(amounts["long"]) == "9999999999999999.99" and str(amounts["text"]) == "4.50" and amounts["null"] is None


def test_row_payload(spark):
    df = spark.createDataFrame([("a", '{"x":[1]}'), ("b", "{broken")], "entry_id string, raw_payload_json string")
    got = {r.entry_id: json.loads(r.body) for r in intake.row_payload(df).collect()}
    assert got["a"]["raw_payload"] == {"x": [1]} and got["b"]["raw_payload"] == "{broken"
    assert got["a"]["submission"] == {"entry_id": "a"}


def test_prefill_address_falls_back_to_current(spark):
    url = "https://x.example/?business_state=ca&business_zip=94110-22&owner_city=%20Oakland+&phone=555"
    current = F.struct(F.lit("1 Old St").alias("street"), F.lit("Oldtown").alias("city"), F.lit("NY").alias("state"), F.lit("10001").alias("zip"))
    row = W.prefill_fields(spark.createDataFrame([(url,)], "url string"), current=current).first()
    assert tuple(row.physical_address) == ("1 Old St", "Oldtown", "CA", "94110")
    assert row.owner_address.city == "Oakland" and row.contact_phone == "(555" and row.contact_name is None
    plain = W.prefill_fields(spark.createDataFrame([("https://x.example/",)], "url string")).first()
    assert plain.physical_address is None


def test_source_and_final_documents_are_verified(spark):
    import hashlib
    body = b"%PDF-1.7 x"
    sha = hashlib.sha256(body).hexdigest()
    v = "underwriting-v1"
    rows = [("ok", "gs://b/ok", v, "7", sha.upper()), ("plain", "gs://b/ok", None, None, None), ("uri", "b/ok", v, "7", sha),
            ("gen", "gs://b/ok", v, "x", sha), ("old", "gs://b/ok", v, "6", sha), ("text", "gs://b/text", v, "7", sha), ("gone", "gs://b/gone", v, "7", sha)]
    subs = spark.createDataFrame(rows, "entry_id string, pdf_gcs_key string, pdf_layout_version string, pdf_source_generation string, pdf_source_sha256 string")
    objects = spark.createDataFrame([("gs://b/ok", "7", "application/pdf", bytearray(body)), ("gs://b/text", "7", "application/pdf", bytearray(b"text"))],
                                    "uri string, generation string, content_type string, content binary")
    found = {r.entry_id: r.error_code for r in LG.verify_sources(subs, objects).collect()}
    assert found == {"ok": None, "plain": None, "uri": "GCS_URI_INVALID", "gen": "SOURCE_GENERATION_INVALID", "old": "SOURCE_INTEGRITY_MISMATCH",
                     "text": "SOURCE_PDF_INVALID", "gone": "SOURCE_PDF_INVALID"}

    final = spark.createDataFrame([("o", "7", bytearray(body), "underwritten-v1", "e", "f", "1", "s", sha)],
        "object_name string, generation string, content binary, artifact_type string, entry_id string, fingerprint string, "
        "source_generation string, source_sha256 string, final_sha256 string")
    def decide(generation, digest):
        expected = spark.createDataFrame([("o", "e", "f", "1", "s", generation, digest)],
            "object_name string, entry_id string, fingerprint string, source_generation string, source_sha256 string, expected_generation string, expected_sha256 string")
        return LG.verify_artifacts(expected, final).first().decision
    assert [decide("7", sha.upper()), decide("8", sha), decide("7", "0" * 64)] == ["reuse", "FINAL_ARTIFACT_MISMATCH", "FINAL_ARTIFACT_MISMATCH"]

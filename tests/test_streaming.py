import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fundlens.operators import events as EV, web as W
from fundlens.operators.intake import parse_extractions
from fundlens.plans import replay_queries as RQ
from fundlens.schemas import LEDGER
from fundlens.streaming import attribution as AT, jobs as J
from fundlens.streaming.buckets import BucketedTable, KnownKeys

from statement_fixture import ledger as fixture_ledger, rows


def write_lines(path, name, lines):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(lines) + "\n")


def ready(entry, expected=2, extracted=2, **extra):
    return json.dumps({
        "event_type": EV.READY_TYPE, "schema_version": 1, "analysis_version": 1,
        "event_key": f"bank_statement_underwriting:{entry}:v1", "entry_id": entry, "status": "READY",
        "expected_document_count": expected, "extracted_document_count": extracted, **extra,
    })


def test_ready_events_are_accepted_once(spark, tmp_path):
    source = tmp_path / "in"
    job = J.ReadyEventJob(spark, str(tmp_path / "out"))
    for name, lines in (("a", [ready("e1"), ready("e1"), "{"]), ("b", [ready("e1"), ready("e2"), '{"event_type":"legacy"}', ready("e3", 2, 0)])):
        write_lines(source, name, lines)
        J.run_batches(J.text_messages(spark, str(source), 1), job, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.entry_id for r in job.accepted.read().collect()) == ["e1", "e2"]
    codes = sorted((r.route, r.code or "") for r in job.rejected.read().collect())
    assert codes == [("invalid", "EVENT_CONTRACT_INVALID"), ("invalid", "EVENT_JSON_INVALID"), ("irrelevant", "")]
    # A replayed batch changes nothing.
    job(spark.createDataFrame([(ready("e1"),), (ready("e2"),)], "value string"), 1)
    assert sorted(r.entry_id for r in job.accepted.read().collect()) == ["e1", "e2"]


def test_keys_are_accepted_once_with_bounded_state(spark, tmp_path):
    source, start = tmp_path / "in", dt.datetime(2024, 1, 1)
    job = J.UniqueJob(spark, str(tmp_path / "out"), "event_key string, at timestamp, body string", ["event_key"], "at", buckets=8)
    sent = []
    for day in range(10):
        keys = [f"k{day}-{i}" for i in range(5)] + [f"k{day}-0"] + ([f"k{day - 7}-1", f"k{day - 1}-2"] if day >= 7 else []) + ([None] if day in (2, 9) else [])
        lines = [{"event_key": k, "at": (start + dt.timedelta(days=day, minutes=i)).isoformat() + "Z", "body": f"{day}:{i}"} for i, k in enumerate(keys)]
        sent += lines
        write_lines(source, f"f{day:02}", map(json.dumps, lines))
        os.utime(source / f"f{day:02}", (day + 1, day + 1))  # files go by time
    stream = spark.readStream.schema("event_key string, at timestamp, body string").option("maxFilesPerTrigger", 1).json(str(source))
    query = J.run_batches(job.near(stream), job, str(tmp_path / "cp"))
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    first = {}
    for line in sent:
        first.setdefault(line["event_key"], line["body"])
    accepted = job.accepted.read().collect()
    assert {r.event_key: r.body for r in accepted} == first and len(accepted) == len(first) == 51
    assert len(state) >= 10 and max(state) <= 20  # keys of the last days, not of all
    # A replay of the last batch changes nothing, and a repeat after a week is refused without any state.
    last = max(r.batch_id for r in accepted)
    again = spark.createDataFrame([("k9-3", start + dt.timedelta(days=9, minutes=3), "9:3"), ("k2-2", start + dt.timedelta(days=9), "late")], job.accepted.schema)
    job(again, last + 1)
    assert job.accepted.read().count() == 51


class Cell:
    """A state variable and the timers of one key, as the state store would keep them."""

    def __init__(self):
        self.value, self.timers = None, []

    def getListState(self, name, kind):
        self.waiting = Cell()
        return self.waiting

    def getValueState(self, name, kind):
        self.record = Cell()
        return self.record

    def registerTimer(self, moment):
        self.timers.append(moment)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def appendList(self, more):
        self.value = (self.value or []) + list(more)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None


def test_a_visitors_timers_do_not_grow_with_the_visits():
    handle, clock, state = Cell(), Cell(), AT.AttributionState()
    state.init(handle)
    hour = 3_600_000_000
    sent = [{"at": i * hour + 5, "visit_id": i, **dict.fromkeys(AT._NAMES)} for i in range(50)]
    list(state.handleInputRows((1,), iter(sent), clock))
    out, fired = [], 0
    for clock.watermark in (20 * 3_600_000, 200 * 3_600_000):
        due = sorted({t for t in handle.timers if t <= clock.watermark})
        handle.timers = [t for t in handle.timers if t > clock.watermark]
        fired += len(due)
        for _ in due:
            out += state.handleExpiredTimer((1,), clock, None)
    assert [r.visit_id for r in out] == list(range(50)) and not handle.waiting.exists()
    assert fired == 2  # one a batch, not one an hour


def test_slices_of_a_replay_are_written_by_many_tasks_and_come_whole(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    visits = spark.createDataFrame([(i, start + dt.timedelta(minutes=i)) for i in range(400)], "id bigint, ts timestamp").repartition(4).persist()
    seen = {}

    def keep(batch, number):
        seen[number] = sorted(r.id for r in batch.collect())

    RQ.replay(RQ.slices(visits, "ts"), visits.schema, str(tmp_path / "in"), lambda stream: J.run_batches(stream, keep, str(tmp_path / "cp")))
    visits.unpersist()
    assert [seen[n] for n in sorted(seen)] == [list(range(i, i + 100)) for i in range(0, 400, 100)]
    assert len([f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")]) == 16


def test_attribution_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    base = "https://apply.example.com/start"
    plan = [
        (1, 1, 0, base + "?utm_source=a&utm_campaign=x"), (1, 2, 5, base), (1, 3, 20, base + "?utm_source=&utm_campaign=y"),
        (1, 4, 45, base), (1, 5, 51, base), (1, 6, 52, base + "?app=rep"), (2, 7, 3, base), (2, 8, 4, base + "?utm_id=7"),
        (2, 9, 34, base + "?utm_term=t"), (2, 10, 33, base),
    ]
    data = [(v, i, start + dt.timedelta(days=d), u) for v, i, d, u in plan]
    visits = spark.createDataFrame(data, "visitor_id bigint, visit_id bigint, ts timestamp, url string")
    columns = ["visit_id", "origin", "app", "utm_id", "utm_source", "utm_campaign", "utm_term"]
    whole = W.resolve_attribution(visits).select(*columns)
    state = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    AT.use_rocksdb(spark)
    # Visits come out of order by up to three days, in several micro-batches; the last ones move the watermark on.
    shuffled = sorted(data, key=lambda r: r[2] + dt.timedelta(days=3) * (r[1] % 2))
    for rows_ in (shuffled[:3], shuffled[3:6], shuffled[6:], [(9, 98, start + dt.timedelta(days=90), base)], [(9, 99, start + dt.timedelta(days=99), base)]):
        spark.createDataFrame(rows_, visits.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(visits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    AT.attribution_stream(stream, "4 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    streamed = spark.read.parquet(out).filter("visit_id < 90").select(*columns)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, streamed.collect()), key=str)
    assert spark.read.format("statestore").option("stateVarName", "record").load(checkpoint).count() == 0  # all lapsed
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load(checkpoint)
    assert waiting.select("key.visitor_id").distinct().collect() == [(9,)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state)
    by_id = {r.visit_id: r for r in whole.collect()}
    assert (by_id[2].origin, by_id[2].utm_source) == ("stored", "a")
    assert (by_id[3].origin, by_id[3].utm_source, by_id[3].utm_campaign) == ("url", "a", "y")
    assert (by_id[4].origin, by_id[5].origin, by_id[5].utm_source) == ("stored", "none", None)
    assert (by_id[6].utm_source, by_id[6].app) == (None, "rep")
    assert (by_id[9].origin, by_id[9].utm_id) == ("url", None)  # exactly 30 days later: lapsed
    assert (by_id[10].origin, by_id[10].utm_id) == ("stored", "7")


def test_delivery_retries_until_dead(spark, tmp_path):
    visible = [("seen",)]
    submissions = lambda: spark.createDataFrame([(e, None) for (e,) in visible], "entry_id string, pdf_layout_version string")
    job = J.DeliveryJob(spark, str(tmp_path / "d"), submissions)
    message = lambda e: json.dumps({"entry_id": e})
    job(spark.createDataFrame([(message("seen"),), (message("late"),), (message("never"),)], "value string"), 0)
    empty = spark.createDataFrame([], "value string")
    visible.append(("late",))
    for batch in range(1, 6):
        job(empty, batch)
    assert sorted((r.entry_id, r.action) for r in job.decided.read().collect()) == [("late", "send"), ("seen", "send")]
    assert [json.loads(r.value)["entry_id"] for r in job.dead.read().collect()] == ["never"]


def test_delivery_retries_without_input(spark, tmp_path):
    visible = [("seen",)]
    submissions = lambda: spark.createDataFrame([(e, None) for (e,) in visible], "entry_id string, pdf_layout_version string")
    job = J.DeliveryJob(spark, str(tmp_path / "d"), submissions)
    message = lambda *entries: spark.createDataFrame([(json.dumps({"entry_id": e}),) for e in entries], "value string")
    assert not job.retry()
    job(message("seen", "late", "never"), 0)
    visible.append(("late",))
    assert job.retry()
    job(message("seen"), 1)
    job(message("seen"), 1)  # a replay
    while job.retry():
        pass
    assert sorted((r.entry_id, r.action) for r in job.decided.read().collect()) == [("late", "send"), ("seen", "send"), ("seen", "send")]
    assert [(json.loads(r.value)["entry_id"], r.attempts) for r in job.dead.read().collect()] == [("never", J.MAX_ATTEMPTS)]
    assert not job.retry()


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("part-*")}


def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    submission = lambda entry, n: (entry, at, [f"gs://b/{entry}-{i}.pdf" for i in range(n)])
    frame = lambda *rows_: spark.createDataFrame(list(rows_), "entry_id string, submitted_at timestamp, bank_statement_gcs_keys array<string>")
    job = J.LedgerJob(spark, str(tmp_path / "l"), buckets=64)
    job(frame(*[submission(f"e{i}", 5) for i in range(200)]), 0)
    before, rows_before = files_of(tmp_path / "l" / "ledger"), {r.document_id: r for r in job.current().collect()}
    assert len({name.split("/")[0] for name in before}) == 64 and len(rows_before) == 1000
    job(frame(submission("e7", 5), submission("new", 5)), 1)
    after, rows_after = files_of(tmp_path / "l" / "ledger"), {r.document_id: r for r in job.current().collect()}
    changed = {n.split("/")[0] for n in before.keys() | after.keys() if before.get(n) != after.get(n)}
    assert 1 <= len(changed) <= 10 and len(rows_after) == 1005
    assert all(rows_after[k] == r for k, r in rows_before.items())
    job(frame(submission("e7", 5), submission("new", 5)), 1)
    assert {r.document_id: r for r in job.current().collect()} == rows_after  # a replay


def test_a_merge_that_was_cut_off_is_completed(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), StructType.fromDDL("k string, n bigint"), ["k"], 4)
    rows_ = lambda *r: spark.createDataFrame(list(r), "k string, n bigint")
    newest = lambda old, new: old.join(new, old.k.eqNullSafe(new.k), "left_anti").unionByName(new).filter("n >= 0")
    table.merge(rows_(*[(f"k{i}", i) for i in range(20)], (None, 5)), newest)
    complete, table._complete = table._complete, lambda: None
    numbers = table.touched(rows_(("k3", 0)))
    table.merge(rows_(("k3", 300)), newest)  # written aside, then lost
    table._complete = complete
    assert {r.k: r.n for r in table.of_keys(rows_(("k3", 0), (None, 0))).collect()} == {"k3": 300, None: 5}
    assert not (tmp_path / "t-next").exists()
    gone = [r.k for r in table.read(numbers).collect()]
    table.merge(rows_(*[(k, -1) for k in gone]), newest)  # nothing is left of that bucket
    assert table.read().count() == 21 - len(gone) and not (tmp_path / "t" / f"bucket={numbers[0]}").exists()
    assert table.merge(rows_(), newest) == []
    known = KnownKeys(spark, str(tmp_path / "k"), table.schema, ["k"], 4)
    known.add(rows_(("a", 1), (None, 1)), 3)
    assert sorted(r.k or "" for r in known.unknown(rows_(("a", 2), ("b", 2), (None, 2)), 4).collect()) == ["b"]
    assert known.unknown(rows_(("a", 2)), 3).count() == 1  # the run that stored it sees it as new again


def test_ledger_job_is_replay_safe(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    sub = lambda *rows_: spark.createDataFrame(list(rows_), "entry_id string, submitted_at timestamp, bank_statement_gcs_keys array<string>")
    job = J.LedgerJob(spark, str(tmp_path / "l"))
    first = sub(("a", at, ["gs://b/1.pdf", "gs://b/2.png"]), ("bad", at, ["gs://b/1.pdf", "gs://b/1.pdf"]))
    job(first, 0)
    job(first, 0)
    job(sub(("a", at, ["gs://b/1.pdf"]), ("c", at, ["gs://b/3.pdf"])), 1)
    rows_ = job.current().select("entry_id", "attempt_count", "ingestion_status").collect()
    assert sorted(map(tuple, rows_)) == [("a", 1, "PENDING"), ("c", 1, "PENDING")]
    assert {(r.entry_id, r.error_code) for r in job.rejected.read().collect()} == {("bad", "DUPLICATE_GCS_URI")}
    assert job.current().schema.names == StructType.fromDDL(LEDGER).names


def as_json(row):
    entry, doc, index, file_id, at, (summary, lines) = row
    names = ["account_number", "bank_name", "company", "start_balance", "end_balance", "statement_start_date",
             "statement_end_date", "total_credits", "total_debits"]
    plain = lambda v: v if v is None or isinstance(v, (str, int)) else str(v) if not hasattr(v, "quantize") else float(v)
    return json.dumps({
        "entry_id": entry, "document_id": doc, "document_index": index, "file_id": file_id, "extracted_at": at.isoformat() + "Z",
        "statement": {"summary": {n: plain(v) for n, v in zip(names, summary)},
                      "transactions": [{"date": plain(d), "description": t, "amount": plain(a)} for d, t, a in lines]},
    })


def test_readiness_fires_once_when_all_documents_arrived(spark, tmp_path):
    main = {r[1]: as_json(r) for r in rows() if r[0] == "main"}
    ledger = fixture_ledger(spark).filter("entry_id in ('main', 'identical')")
    job = J.ReadinessJob(spark, str(tmp_path / "r"), lambda: ledger)
    batch = lambda *lines: spark.createDataFrame([(line,) for line in lines], "value string")
    broken = json.loads(main["main_3"])
    del broken["statement"]["summary"]["company"]
    job(batch(main["main_1"], main["main_2"], json.dumps(broken)), 0)
    assert job.emitted.read().count() == 0 and job.rejected.read().count() == 1
    job(batch(main["main_3"]), 1)
    job(batch(main["main_3"]), 1)
    job(batch(main["main_2"]), 2)
    assert {r.batch_id for r in job.extractions_of(ledger.filter("file_id = 'file_main_3'").select("file_id"), 2).collect()} == {1}
    emitted = [r for r in job.emitted.read().collect() if r.entry_id == "main"]
    assert [(r.entry_id, r.status, r.expected_document_count) for r in emitted] == [("main", "REVIEW_REQUIRED", 3)]
    good, bad = parse_extractions(batch(*main.values()))
    assert (good.count(), bad.count()) == (3, 0)
    assert good.filter("file_id = 'file_main_1'").first().statement.summary.end_balance == 39300


def test_unique_journey(spark, tmp_path):
    rows_ = [("s", 1, "00:01", "application_start", None), ("s", 2, "00:02", "application_start", None), ("s", 3, "00:03", "application_step_view", 2),
             ("s", 4, "00:04", "application_step_view", 2), ("s", 5, "00:05", "application_step_complete", 2), ("s", 6, "00:06", "application_step_complete", 2),
             ("s", 7, "00:07", "something_else", None)]
    for row in rows_:
        names = ("session_id", "event_id", "ts", "event", "step_number")
        body = dict(zip(names, row), error_category=None)
        body["ts"] = f"2024-01-01T{row[2]}:00Z"
        write_lines(tmp_path / "in", f"f{row[1]}", [json.dumps(body)])
    stream = spark.readStream.schema(
        "session_id string, event_id bigint, ts timestamp, event string, step_number int, error_category string"
    ).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    J.unique_journey(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start().awaitTermination()
    found = [r.event for r in spark.read.parquet(out).collect()]
    assert sorted(found) == ["application_start", "application_step_complete", "application_step_complete", "application_step_view"]


def test_new_documents_are_appended_and_changed_ones_written_anew(spark, tmp_path, monkeypatch):
    at = dt.datetime(2024, 1, 1)
    frame = lambda *names: spark.createDataFrame([(n, at, [f"gs://b/{n}-{i}.pdf" for i in range(3)]) for n in names], "entry_id string, submitted_at timestamp, bank_statement_gcs_keys array<string>")
    job = J.LedgerJob(spark, str(tmp_path / "l"), buckets=1)
    files = lambda: files_of(tmp_path / "l" / "ledger")
    job(frame("a"), 0)
    first = files()
    job(frame("a", "b"), 1)
    second, known = files(), {r.document_id: r for r in job.current().collect()}
    assert len(first) == 1 and len(second) == 2 and first.items() <= second.items() and len(known) == 6
    job(frame("a", "b"), 1)
    assert files() == second and {r.document_id: r for r in job.current().collect()} == known  # a replay
    # A document that lost its provider is retried, in place.
    job.ledger.merge(job.current().filter("entry_id = 'a'").withColumn("extraction_provider", F.lit(None).cast("string")),
                     lambda old, new: old.join(new.select("document_id"), "document_id", "left_anti").select(*new.columns).unionByName(new))
    job(frame("a", "c"), 2)
    found = [(r.entry_id, r.attempt_count, r.extraction_provider, r.source_event_id) for r in job.current().collect()]
    assert sorted(set(found)) == [("a", 2, "openai", "batch-2"), ("b", 1, "openai", "batch-1"), ("c", 1, "openai", "batch-2")] and len(found) == 9
    monkeypatch.setattr("fundlens.streaming.buckets.FILES", 0)
    job(frame("d"), 3)  # too many files by then
    assert len(files()) == 1 and job.current().count() == 12


def test_an_append_that_was_cut_off_is_completed(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), StructType.fromDDL("k string, n bigint"), ["k"], 4)
    rows_ = lambda *r: spark.createDataFrame(list(r), "k string, n bigint")
    more = rows_(*[(f"k{i}", i) for i in range(20)])
    table.append(more, table.touched(more))
    move, moved = table._move, []
    again = rows_(*[(f"l{i}", i) for i in range(20)])

    def once(path, to):
        if moved:
            raise OSError("lost")
        moved.append(to)
        move(path, to)

    table._move = once
    with pytest.raises(OSError, match="lost"):
        table.append(again, table.touched(again))
    table._move = move
    assert sorted(r.k for r in table.read().collect()) == sorted(f"{x}{i}" for x in "kl" for i in range(20))
    assert moved and not (tmp_path / "t-next").exists()

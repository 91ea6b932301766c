"""WARC and chat round trips, nearest neighbours against brute force, the mix against its rules."""

import base64
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.llm import chat, mixing, queries, vp_tree, warc

# ---- WARC -----------------------------------------------------------------------


def test_chunked_framing_round_trip():
    for payload in (b"", b"x", b"\r\n0\r\n\r\n" * 5000, "é☺".encode() * 9000):
        assert warc.dechunked(warc.chunked(payload, 100)) == payload
    assert warc.dechunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def test_archive_round_trip(spark, tmp_path):
    long = "é☺ text, <p>\r\n\r\n" * 9000
    rows = [(1, "http://a/", long), (2, "http://b/", long), (3, None, "x" * 999), (4, "u\r\nv w", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", "y" * 1000),
            (8, "u", "y" * 1000), (8, "u", "y" * 1000), (None, "u", "y" * 1000), (None, "u", "z"), (9, "WARC/1.1", "WARC/1.1\r\nContent-Length: 5\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    warc.write(pages, f"{tmp_path}/w", segment=5000)
    found = warc.read(spark, f"{tmp_path}/w").withColumn("page_id", warc.page_of("record_id")).withColumn("to", warc.page_of("refers_to")).collect()
    assert len(found) == len(rows) and all(r.error is None for r in found)
    keeper = {long: 2, "y" * 1000: 8}
    expected = []
    for key, _, html in rows:
        raw = (html or "").encode()
        revisit = html in keeper and key != keeper[html]
        expected.append((key, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keeper[html] if revisit else None, None if revisit else raw))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.type, r.to, None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_faulty_segments_are_told(spark, tmp_path):
    body = warc.chunked(b"abcdefgh" * 10)
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"abcdefgh" * 10).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body

    def record(key, number, part, total=None, kind="continuation"):
        head = {"WARC-Type": kind, "WARC-Record-ID": key if number == 1 else f"<s:{key}:{number}>", "WARC-Segment-Number": number, "WARC-Payload-Digest": digest, "Content-Length": len(part)}
        head |= {"WARC-Segment-Origin-ID": key} if number > 1 else {}
        head |= {"WARC-Segment-Total-Length": total} if total else {}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + part + b"\r\n\r\n"

    a, b, c = block[:50], block[50:70], block[70:]
    size = len(block)
    records = [record("<good>", 3, c, size), record("<good>", 1, a, kind="response"), record("<good>", 2, b), record("<good>", 2, b),
               record("<gap>", 1, a, kind="response"), record("<gap>", 3, c, size), record("<short>", 1, a, kind="response"), record("<short>", 2, b + c, size + 1),
               record("<cut>", 1, a, kind="response"), record("<odd>", 1, a, kind="response"), record("<odd>", 2, b + c[:-8] + b"xx" + c[-6:], size)]
    (tmp_path / "part-0").write_bytes(b"".join(records[::2]))
    (tmp_path / "part-1").write_bytes(b"".join(records[1::2]))
    found = {r.record_id: (r.error, r.payload) for r in warc.read(spark, str(tmp_path)).collect()}
    assert found["<good>"][0] is None and bytes(found["<good>"][1]) == b"abcdefgh" * 10
    assert "missing" in found["<gap>"][0] and "bytes" in found["<short>"][0] and all(found[x][0] for x in ("<cut>", "<odd>"))


def test_empty_archive(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.read(spark, f"{tmp_path}/w").count() == 0


# ---- nearest neighbours -------------------------------------------------------------


def brute_nearest(rows, asked, k=5):
    out = []
    usable = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v) and i is not None]
    for q in sorted(asked):
        one = next((v for i, v in usable if i == q), None)
        if one is None:
            continue
        near = sorted((-float(vp_tree.cosines(one, v[None])[0]), i) for i, v in usable if i != q and len(v) == len(one))
        out += [(q, r + 1, i, pytest.approx(-s, abs=1e-12)) for r, (s, i) in enumerate(near[:k])]
    return out


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + rng.normal(size=8) * 0.3).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[50][1]) for i in range(400)]  # a family of equal vectors
    rows += [(3000, None), (3050, [0.0] * 8), (3100, [1.0, None] + [0.0] * 6), (3150, [float("nan")] * 8), (3200, [1.0, 2.0]), (3250, [2.0, 1.0]), (3300, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own"))
    asked = df.filter("vec_id % 50 = 0")
    index = vp_tree.build_index(df, shard_rows=300)
    found = [tuple(r) for r in vp_tree.nearest(index, asked).orderBy("query_id", "rank").collect()]
    assert found == brute_nearest(rows, [i for i, _ in rows if i is not None and i % 50 == 0])
    exact = {(q, i) for q, _, i, _ in found}
    less = {(r.query_id, r.vec_id) for r in vp_tree.nearest(index, asked, factor=0.5).collect()}
    assert 0.5 < len(exact & less) / len(exact) <= 1


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.0]), (51, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in vp_tree.nearest(vp_tree.build_index(df), df.filter("vec_id = 0")).collect()] == [(0, 1, 50), (0, 2, 51)]
    none = df.limit(0)
    assert vp_tree.nearest(vp_tree.build_index(none), none).count() == 0


def test_extreme_vectors_have_their_cosines(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.0]), (2, [1e-200, 1e-200]), (3, [5e-324, 0.0]), (4, [-1e300, 1e300]), (5, [3.0, 3.0]), (6, [-0.0, 2.0]), (7, [0.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vp_tree.nearest(vp_tree.build_index(df, k=7), df, k=7).collect()
    half = 0.5**0.5
    directions = {0: (half, half), 1: (1, 1e-200), 2: (half, half), 3: (1, 0), 4: (-half, half), 5: (half, half), 6: (0, 1), 7: (0, 1)}
    assert len(found) == 8 * 7
    for r in found:
        assert r.score == pytest.approx(np.dot(directions[r.query_id], directions[r.vec_id]), abs=1e-12)
    assert {r.vec_id for r in found if r.query_id == 0 and r["rank"] <= 2} == {2, 5}


def test_repeated_ids_and_rows(spark):
    """Equal rows count once; an id with two vectors has two lists, neither with a row of its own id."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0])] + [(i, [1.0, i / 10]) for i in range(1, 8)] + [(9, [0.1 * i, 1.0]) for i in range(3)] + [(1, [1.0, 0.1])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lists = {}
    for r in vp_tree.nearest(vp_tree.build_index(df, k=3), df.filter("vec_id = 0"), k=3).orderBy("rank").collect():
        lists.setdefault(r["rank"], set()).add(r.vec_id)
    assert lists == {1: {1, 9}, 2: {2, 9}, 3: {3, 9}}


def test_an_index_answers_up_to_its_k(spark):
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(100 + i, [1.0, 0.1 + i]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="k = 5"):
        vp_tree.nearest(vp_tree.build_index(df), df.filter("vec_id = 0"), k=10)
    index = vp_tree.build_index(df, k=10)
    for k in (10, 3):
        assert [tuple(r) for r in vp_tree.nearest(index, df.filter("vec_id = 0"), k=k).orderBy("rank").collect()] == brute_nearest(rows, [0], k)
    assert vp_tree.nearest(vp_tree.build_index(df.limit(0)), df, k=10).count() == 0


# ---- chat ----------------------------------------------------------------------------


def test_layouts_become_equal_turns(spark):
    said = [("user", "Hi #1 \\ <b>"), ("assistant", "</turn>\n### x")]
    records = [
        {"id": 1, "messages": [{"role": r, "content": t} for r, t in said]}, {"id": 2, "conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in said]},
        {"id": 3, "prompt": said[0][1], "completion": said[1][1]}, {"id": 4, "prompt": said[0][1], "response": said[1][1]}, {"id": 5, "instruction": said[0][1], "output": said[1][1]},
        {"id": 6, "prompt": said[0][1], "response": said[1][1], "system": None}, {"id": 7, "odd": [1]}, {"id": 8, "messages": []},
    ]
    raw = [json.dumps(r) for r in records] + [json.dumps({"conv_id": 9, "turn": i, "role": r, "text": t}) for i, (r, t) in enumerate(said)] + ["not json", None, "[1]"]
    turns = chat.canonical_turns(spark.createDataFrame([(r,) for r in raw], "record string"))
    known = {}
    for r in turns.filter("role is not null").orderBy("conv_id", "pos").collect():
        known.setdefault(r.conv_id, []).append((r.role, r.text))
    assert known == {str(i): said for i in (1, 2, 3, 4, 5, 6, 9)}
    assert turns.filter("layout like 'unknown:%'").count() == 5


def test_template_reads_back():
    for role in ("user", "a\nb", "### ", "\\", ""):
        for text in ("", "\\### Assistant: </turn> ok", "</turn>\n### user\n", "\\\\##<<", "a\r\n\t é☺", "\\"):
            piece, begin, end = chat.format_turn(role, text)
            assert chat.parse_turn(piece) == (role, text) and chat.unescape(piece[begin:end]) == text
            assert piece[begin:end].count("</turn>") == 0 and piece[len("### "):].count("### ") == 0


def test_conversations_digest(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "\\#"), (3, 0, "assistant", "t"), (3, 0, "assistant", "t"),
            (4, 0, "user", "long " * 100_000)] + [(5, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    found = {r.conv_id: r for r in chat.format_and_read_back(records).collect()}
    assert set(found) == {"1", "2", "3", "4", "5", None}
    for key, r in found.items():
        own = sorted((t for t in rows if str(t[0]) == str(key)), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_and_read_back(records.limit(0)).count() == 0


def test_hot_conversation_is_read_in_its_written_order(spark, tmp_path):
    """A conversation with a third of all turns lies in one file, and misplaced parts are told."""
    rows = [(1, i, "assistant", f"{i} " * 50) for i in range(4000)] + [(2 + i % 800, i, "user", f"u{i}") for i in range(8000)]
    records = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(F.to_json(F.struct("*")).alias("record")).repartition(7)
    formatted = chat.format_conversations(chat.canonical_turns(records))
    chat.write_formatted(formatted, f"{tmp_path}/f")
    found = chat.read_written(spark, f"{tmp_path}/f")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, chat.read_back(formatted).collect()))
    formatted.filter("part % 2 = 0").coalesce(1).write.json(f"{tmp_path}/g", compression="gzip")
    with pytest.raises(Exception, match="stands where part"):
        chat.read_written(spark, f"{tmp_path}/g").collect()


# ---- mixing --------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), percent=150):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    budget, full = percent / 100 * sum(sizes.values()), set()
    while True:
        left, open_ = budget - sum(2 * sizes[n] for n in full), [n for n in names if n not in full]
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        new = {n for n in open_ if share[n] > 2 * sizes[n]}
        if not new:
            return {n: 2.0 * sizes[n] if n in full else share[n] for n in names}
        full |= new


def test_mix_follows_its_targets(spark):
    rng = np.random.default_rng(6)
    sources = ["b", "B", "é", None, "a", "tiny", "zz"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200))), "a" if i % 3 == 0 else sources[int(rng.integers(7))] if i % 50 else "tiny") for i in range(4000)]
    rows += [(None, "a b c", "a"), (7, "a b c", "a"), (7, "a b c", "a"), (9000, None, "b"), (9001, "", None), (9002, "w " * 60_000, "zz"), (9003, None, "empty source")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("own"))
    found = mixing.mix(docs)
    result = mixing.taken_words(found).collect()
    assert len(result) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in result)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = brute_targets(sizes)
    taken = {r.source: r for r in found.documents.groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("size")).collect()}
    of = found.pieces.join(found.documents.select("sid", "first", "source", "size").filter("size > 0"), ["sid", "first"]).groupBy("source").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n"))
    got = {r.source: r.n for r in of.collect()}
    for name, target in targets.items():
        assert taken[name].target == pytest.approx(target) and taken[name].size == sizes[name]
        assert abs(got.get(name, 0) - target) <= 0.02 * target + 4 * found.block_words
    again = mixing.taken_words(mixing.mix(docs.repartition(7))).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, result), key=repr)


def test_tiny_sources_beside_hot_ones_reach_their_targets(spark):
    sizes = {"a": 400_000, "b": 300_000, "c": 20_000, "d": 5_003, "e": 500, "f": 50, "g": 7, "h": 1}
    rows = [(i, n, min(4_001, size - n), name) for i, (name, size) in enumerate(sizes.items()) for n in range(0, size, 4_001)]
    docs = spark.createDataFrame([(10_000 * i + n, "w " * size, name) for i, n, size, name in rows], "doc_id long, text string, source string")
    found = mixing.mix(docs)
    taken = {r.source: r.n for r in found.documents.select("sid", "first", "source").join(found.pieces, ["sid", "first"]).groupBy("source").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).collect()}
    for name, target in brute_targets(sizes).items():
        assert taken.get(name, 0) == pytest.approx(target, rel=1e-3, abs=0.5), name
    result = mixing.taken_words(found).collect()
    assert len(result) == len(rows) and sum(r.taken for r in result) == sum(taken.values()) and all(r.taken <= 2 * r["size"] for r in result)
    # A source taken twice is taken whole twice, and no piece overlaps another of its pass.
    assert all(r.taken == 2 * r["size"] for r in result if r.target == 2 * r.source_size)
    seen = {}
    for r in found.pieces.collect():
        seen.setdefault((r.sid, r.epoch), []).append((r.first + r.from_word, r.first + r.to_word))
    assert all(a[1] <= b[0] for spans in seen.values() for a, b in zip(sorted(spans), sorted(spans)[1:]))


def test_every_stretch_of_the_mix_has_its_shares(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    found = mixing.mix(docs)
    slots = found.schedule.orderBy("slot").collect()
    shares = found.documents.groupBy("sid").agg(F.first("target").alias("t")).collect()
    total = sum(r.t for r in shares)
    for begin in (0, 500, 1500):
        part = [r.sid for r in slots[begin : begin + 300]]
        for r in shares:
            assert abs(part.count(r.sid) / 300 - r.t / total) < 0.02


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mixing.taken_words(mixing.mix(docs)).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixing.taken_words(mixing.mix(docs.limit(0))).count() == 0


# ---- pipeline ------------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf).cache()
        assert docs.columns == columns and 0.8 * before <= docs.count() <= before, name
        before = docs.count()
    assert before < 1000 and corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == before

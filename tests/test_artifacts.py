"""Create-only artifacts: concurrent writers, differing ones, writers that died half way."""

import hashlib
import threading

import pytest

from fundlens.sources import artifacts as AR

SHAPE = "object_name string, content binary, entry_id string, fingerprint string, source_generation string, source_sha256 string"


def row(name, content, entry="e", fingerprint="f", source="s"):
    return {"object_name": name, "content": content, "entry_id": entry, "fingerprint": fingerprint, "source_generation": "1", "source_sha256": source}


def sha(content):
    return hashlib.sha256(content).hexdigest()


def objects(path):
    return sorted(str(f.relative_to(path)) for f in path.rglob("*") if f.is_file())


def test_a_name_is_given_once(tmp_path):
    store = AR.FolderStore(f"file://{tmp_path}")
    assert AR.commit(store, row("a/x.pdf", b"one"))[:2] == ("create", sha(b"one"))
    assert AR.commit(store, row("a/x.pdf", b"one"))[:2] == ("reuse", sha(b"one"))
    assert AR.commit(store, row("a/x.pdf", b"rendered anew"))[:2] == ("reuse", sha(b"one"))
    assert AR.commit(store, row("a/x.pdf", b"one", fingerprint="other")) == ("FINAL_ARTIFACT_MISMATCH", sha(b"one"), None)
    assert AR.commit(store, row("../x.pdf", b"one"))[0] == "OBJECT_NAME_INVALID"
    assert AR.commit(store, row(None, b"one"))[0] == AR.commit(store, row("b", None))[0] == "FINAL_RENDER_INVALID"
    assert store.create("empty", b"") and store.read("empty") == b"" and store.read("none") is None
    assert objects(tmp_path) == ["a/x.pdf", "a/x.pdf.record", "empty"]
    (tmp_path / "a" / "x.pdf").write_bytes(b"changed")
    assert AR.commit(store, row("a/x.pdf", b"one"))[:2] == ("FINAL_ARTIFACT_MISMATCH", sha(b"changed"))


def test_a_writer_that_died_is_taken_up(tmp_path):
    store = AR.FolderStore(str(tmp_path))
    store.create("x.record", AR.record_of(row("x", b"one"), b"one"))  # and no bytes
    assert AR.commit(store, row("x", b"two", fingerprint="other"))[:2] == ("FINAL_ARTIFACT_MISMATCH", None)
    assert AR.commit(store, row("x", b"one"))[0] == "create" and store.read("x") == b"one"


@pytest.mark.parametrize("second", [b"same", b"other"])
def test_concurrent_runs_leave_one_object(spark, tmp_path, second):
    names = [f"n/{i}.pdf" for i in range(60)]
    fingerprint = "f" if second == b"same" else "g"
    runs = [spark.createDataFrame([row(n, c, fingerprint=f) for n in names], SHAPE).repartition(4) for c, f in ((b"same", "f"), (second, fingerprint))]
    found = [None, None]
    threads = [threading.Thread(target=lambda i=i: found.__setitem__(i, AR.create_artifacts(runs[i], AR.FolderStore(str(tmp_path))).collect())) for i in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    decisions = {n: sorted(r.decision for f in found for r in f if r.object_name == n) for n in names}
    assert set(map(tuple, decisions.values())) == {("create", "reuse") if second == b"same" else ("FINAL_ARTIFACT_MISMATCH", "create")}
    assert objects(tmp_path) == sorted([*names, *[f"{n}.record" for n in names]])
    winners = {r.object_name: r.actual_sha256 for f in found for r in f if r.decision == "create"}
    assert {n: sha((tmp_path / n).read_bytes()) for n in names} == winners
    third = AR.create_artifacts(runs[0], AR.FolderStore(str(tmp_path))).collect()
    assert {r.decision for r in third} <= {"reuse", "FINAL_ARTIFACT_MISMATCH"}


def test_names_that_are_taken_are_not_written_again(tmp_path, monkeypatch):
    store, flushed, fsync = AR.FolderStore(str(tmp_path)), [], AR.os.fsync
    monkeypatch.setattr(AR.os, "fsync", lambda f: (flushed.append(f), fsync(f)))
    assert [AR.commit(store, row(f"a/{i}.pdf", b"one"))[0] for i in (1, 2)] == ["create"] * 2 and len(flushed) == 4
    assert [AR.commit(store, row(f"a/{i}.pdf", b"anew"))[:2] for i in (1, 2)] == [("reuse", sha(b"one"))] * 2
    assert AR.commit(store, row("a/1.pdf", b"one", fingerprint="other"))[0] == "FINAL_ARTIFACT_MISMATCH"
    assert len(flushed) == 4 and objects(tmp_path) == ["a/1.pdf", "a/1.pdf.record", "a/2.pdf", "a/2.pdf.record"]


def test_links_do_not_lead_out_of_the_folder(tmp_path):
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "x").write_bytes(b"secret")
    (root := tmp_path / "root").mkdir()
    store = AR.FolderStore(str(root))
    assert store.create("a/x", b"1") and store.create("a/b/../y", b"2") and store.read("a/y") == b"2"
    (root / "out").symlink_to(tmp_path / "outside")
    (root / "a" / "l").symlink_to(tmp_path / "outside" / "x")
    for name in ("out/x", "a/l", "a/../../outside/x", "/etc/hosts", "", "a/.."):
        assert AR.commit(store, row(name, b"one"))[0] == "OBJECT_NAME_INVALID"
    assert AR.commit(store, row("a\0b", b"one"))[0] not in ("create", "reuse")

"""Artifacts that are created once, by tasks: a name that is taken is never overwritten, but read back and verified."""

from __future__ import annotations

import hashlib
import json
import os
import pathlib
import uuid
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ledger import ARTIFACT_TYPE
from ..session import package_on_workers

IDENTITY = ["entry_id", "fingerprint", "source_generation", "source_sha256"]
RESULT = "object_name string, decision string, actual_sha256 string, generation string"


class Store(Protocol):
    """What the tasks need of an object store; it is sent to them, so it holds settings and no connections."""

    def create(self, name: str, data: bytes) -> bool:
        """Stores a new object whole; False, and no change, if the name is taken."""

    def read(self, name: str) -> bytes | None: ...

    def generation(self, name: str) -> str: ...


class FolderStore:
    """Objects as files of a folder that all tasks see. A file is written under a name of its own and then linked to
    its place, which the file system does for one writer only."""

    def __init__(self, root: str):
        self.root = root.removeprefix("file://")
        self._folders: dict[str, str] = {}  # folders of plain names, by their part of the name, once seen to be inside

    def _place(self, name: str) -> str:
        parts = name.split("/")
        if "\0" in name or any(part in ("", ".", "..") for part in parts):
            return self._resolved(name)
        above = "/".join(parts[:-1])
        folder = self._folders.get(above)
        if folder is None:
            # Many objects share a folder, so it is resolved once. A folder that is not there yet may become a link.
            folder = os.path.dirname(self._resolved(f"{above}/x" if above else "x"))
            if not os.path.isdir(folder):
                return self._resolved(name)
            self._folders[above] = folder
        place = os.path.join(folder, parts[-1])
        return self._resolved(name) if os.path.islink(place) else place

    def _resolved(self, name: str) -> str:
        root = pathlib.Path(self.root).resolve()
        place = (root / name).resolve()
        if root not in place.parents:
            raise ValueError("OBJECT_NAME_INVALID")
        return str(place)

    def create(self, name: str, data: bytes) -> bool:
        place = self._place(name)
        if os.path.exists(place):
            return False  # nothing is written, and nothing flushed to disk, for a name that is taken
        os.makedirs(os.path.dirname(place), exist_ok=True)
        own = os.path.join(os.path.dirname(place), f".{uuid.uuid4().hex}")
        try:
            with open(own, "xb") as out:
                out.write(data)
                out.flush()
                os.fsync(out.fileno())
            os.link(own, place)
            return True
        except FileExistsError:
            return False
        finally:
            pathlib.Path(own).unlink(missing_ok=True)

    def read(self, name: str) -> bytes | None:
        try:
            with open(self._place(name), "rb") as stored:
                return stored.read()
        except FileNotFoundError:
            return None

    def generation(self, name: str) -> str:
        return str(os.stat(self._place(name)).st_mtime_ns)


def record_of(row: dict, content: bytes) -> bytes:
    """What is recorded of an artifact; the same for the same artifact, whoever writes it."""
    known = {"artifact_type": ARTIFACT_TYPE, **{c: row[c] for c in IDENTITY}, "final_sha256": hashlib.sha256(content).hexdigest()}
    return json.dumps(known, sort_keys=True).encode()


def commit(store: Store, row: dict) -> tuple[str, str | None, str | None]:
    """(decision, SHA-256 of the stored bytes, generation) of one artifact.

    The record goes first, so what an artifact has to be is settled before its bytes are there. A writer that died in
    between is taken up by whoever brings the same artifact; one that brings another is told.
    """
    name, content = row["object_name"], row["content"]
    if name is None or content is None:
        return "FINAL_RENDER_INVALID", None, None
    wanted = record_of(row, content)
    try:
        if not store.create(f"{name}.record", wanted) and (found := store.read(f"{name}.record")) != wanted:
            recorded = {} if found is None else json.loads(found)
            same = found is not None and all(recorded.get(c) == row[c] for c in IDENTITY)
            stored = store.read(name)
            digest = None if stored is None else hashlib.sha256(stored).hexdigest()
            # The same application rendered anew: what is there counts, if it is what its record says.
            if same and digest == recorded["final_sha256"]:
                return "reuse", digest, store.generation(name)
            return "FINAL_ARTIFACT_MISMATCH", digest, None
        decision = "create" if store.create(name, content) else "reuse"
        stored = store.read(name)
    except ValueError as wrong:
        return str(wrong), None, None
    digest = hashlib.sha256(stored).hexdigest()
    if digest != json.loads(wanted)["final_sha256"]:
        return "FINAL_ARTIFACT_MISMATCH", digest, None
    return decision, digest, store.generation(name)


def create_artifacts(candidates: DataFrame, store: Store) -> DataFrame:
    """Stores each candidate (object_name, content, entry_id, fingerprint, source_generation, source_sha256) where its
    name is free; (object_name, decision, actual_sha256, generation) of each.

    ``create``: this run stored it. ``reuse``: it was there, and is the artifact wanted: of the same application, with
    the bytes that its record names. ``FINAL_ARTIFACT_MISMATCH``: something else has the name, and stays. Repeated and
    concurrent runs, retries and speculative tasks leave one object. The result is of one pass: write it, or use
    it once; a second pass finds what the first has stored.
    """
    package_on_workers(candidates.sparkSession)

    def run(batches):
        for batch in batches:
            out = [(r["object_name"], *commit(store, r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], ["object_name", "decision", "actual_sha256", "generation"])

    rows = candidates.select("object_name", F.col("content").cast("binary").alias("content"), *[F.col(c).cast("string").alias(c) for c in IDENTITY])
    return rows.mapInArrow(run, RESULT)

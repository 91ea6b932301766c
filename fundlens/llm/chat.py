"""Chat formatting: records of different layouts become canonical turns, and turns a template text that reads back.

The layout of a record is told by its fingerprint: a hash of its sorted nested field paths. Each known fingerprint has
a declarative mapping (where the conversation's key, order, roles and texts are), so a new layout is a new entry, not
new code. Turns are rows throughout: a conversation of any length is formatted, read back and digested as a stream of
its sorted turns, never as one value.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Stage, arrow_rows

ASSISTANT = "assistant"


@dataclass(frozen=True)
class Mapping:
    """``each``: path of the list of turns, empty if the record is one turn or lists its turns in ``fixed``.
    ``role``, ``text``, ``order``: field names within a turn; ``roles`` renames roles. ``fixed``: (role, path) in
    order, where empty optional texts are no turn."""

    key: str
    each: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


_SHARED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Field paths of a layout and its mapping.
LAYOUTS: tuple[tuple[tuple[str, ...], Mapping], ...] = (
    (("conv_id", "role", "text", "turn"), Mapping("conv_id", role="role", text="text", order="turn")),
    (("id", "messages[].content", "messages[].role"), Mapping("id", each="messages", role="role", text="content")),
    (("conversations[].from", "conversations[].value", "id"), Mapping("id", each="conversations", role="from", text="value", roles=_SHARED)),
    (("completion", "id", "prompt"), Mapping("id", fixed=(("user", "prompt"), ("assistant", "completion")))),
    (("id", "prompt", "response"), Mapping("id", fixed=(("user", "prompt"), ("assistant", "response")))),
    (("id", "prompt", "response", "system"), Mapping("id", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",))),
    (("id", "instruction", "output"), Mapping("id", fixed=(("user", "instruction"), ("assistant", "output")))),
    (("id", "input", "instruction", "output"), Mapping("id", fixed=(("system", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",))),
)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths; list items share the path ``name[]``. Empty lists and objects count as their own path."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(found) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: dict, mapping: Mapping) -> list[tuple[int | None, str, str]]:
    """(order, role, text) of the record's turns."""
    if mapping.fixed:
        turns = [(role, _text(record[path])) for role, path in mapping.fixed if record[path] or path not in mapping.optional]
        return [(i, role, text) for i, (role, text) in enumerate(turns)]
    renamed = dict(mapping.roles)
    items = record[mapping.each] if mapping.each else [record]
    return [
        (item[mapping.order] if mapping.order else i, renamed.get(_text(item[mapping.role]), _text(item[mapping.role])), _text(item[mapping.text]))
        for i, item in enumerate(items)
    ]


TURNS = "conv_id string, pos long, role string, text string, layout string"


def canonical_turns(records: DataFrame, column: str = "record", layouts=LAYOUTS) -> DataFrame:
    """Rows (conv_id, pos, role, text, layout) of JSON records; null texts and roles are empty.

    Records of unknown layout, or that are no JSON object, keep one row without role and text, whose layout is
    'unknown:' and the fingerprint.
    """
    known = {fingerprint(found): mapping for found, mapping in layouts}

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    out.append((None, None, None, None, "unknown:"))
                    continue
                mark = fingerprint(paths(record))
                if mark not in known:
                    out.append((None, None, None, None, f"unknown:{mark}"))
                    continue
                own = record[known[mark].key]
                out += [(None if own is None else str(own), pos, role, text, mark) for pos, role, text in canonical(record, known[mark])]
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, types)], ["conv_id", "pos", "role", "text", "layout"])

    return records.select(column).mapInArrow(run, TURNS)


# ---- template -------------------------------------------------------------------

#: A turn is OPEN role newline text CLOSE. Within roles and texts each sign below is a backslash and a letter, so
#: neither control string can occur there, not even as part of an escape.
OPEN, CLOSE = "### ", "</turn>\n"
_LETTERS = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_SIGNS = re.compile(r"[\\#<]")
_CODES = {v: k for k, v in _LETTERS.items()} | {"\\n": "\n"}
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_TURN = re.compile(r"### ([^#<\n]*)\n([^#<]*)</turn>\n")


def escape(text: str) -> str:
    return _SIGNS.sub(lambda m: _LETTERS[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _CODES[m[0]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's text in the template, and where its content begins and ends in it."""
    head = OPEN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turn(piece: str) -> tuple[str, str]:
    found = _TURN.fullmatch(piece)
    if found is None:
        raise ValueError("not one turn of the template")
    return unescape(found[1]), unescape(found[2])


FORMATTED = "conv_id string, part long, formatted string, turn_at long, loss_from long, loss_to long"


def _format(batches):
    """Parts of each conversation in order; offsets count code points from the conversation's beginning."""
    now, part, at = ..., 0, 0
    for batch in batches:
        out = []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if conv != now:
                now, part, at = conv, 0, 0
            piece, begin, end = format_turn(role or "", text or "")
            loss = role == ASSISTANT
            out.append((conv, part, piece, at, at + begin if loss else None, at + end if loss else None))
            part, at = part + 1, at + len(piece)
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, types)], [x.split()[0] for x in FORMATTED.split(", ")])


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *columns)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, part, formatted, turn_at, loss_from, loss_to): the parts of a conversation, in order, are its
    text; the loss mask covers loss_from to loss_to, the assistant's texts. Turns are ordered by pos (null first), then
    role and text; a null conversation key is one conversation. Rows without role and text (unknown layouts) go."""
    known = turns.filter("role IS NOT NULL").select("conv_id", "pos", "role", "text")
    return _in_order(known, "pos", "role", "text").mapInArrow(_format, FORMATTED)


DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    """Reads sorted parts; a part that is missing, repeated or out of order is an error, never a wrong digest."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now = state = None

    def row():
        n, turns, loss_chars, loss, chars = state
        return now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    for batch in batches:
        out = []
        for conv, part, piece, at, begin, end in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if state is None or conv != now:
                if state is not None:
                    out.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if part != state[0]:
                raise ValueError(f"part {part} of conversation {conv} stands where part {state[0]} belongs")
            role, text = parse_turn(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if begin is not None:
                masked = unescape(piece[begin - at : end - at])
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
            state[4] += len(piece)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, types)], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted parts alone: number of turns, digest of the parsed turns, length and
    digest of the text under the loss mask, length of the formatted text."""
    return _in_order(formatted, "part").mapInArrow(_digest, DIGEST)


#: Longest text that the files hold, in characters: the most that one value of Spark can have.
LONGEST = (1 << 31) - 1


def write_formatted(formatted: DataFrame, path: str) -> None:
    """Writes the parts of ``format_conversations`` as lines of JSON. Each task writes one compressed file, in its order,
    so a conversation lies in one file from its first part to its last."""
    formatted.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", 0).json(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """``read_back`` of a folder of ``write_formatted``, without another shuffle: compressed lines are never split, so a
    task reads whole files and meets the parts of a conversation as they were written (which it verifies)."""
    reader = spark.read.schema(FORMATTED).option("mode", "FAILFAST").option("maxStringLen", LONGEST)
    return reader.json(path).mapInArrow(_digest, DIGEST)


def format_and_read_back(records: DataFrame, column: str = "record") -> DataFrame:
    """Formats JSON records, writes the result, and reads it back. Turns are shuffled once, by conversation; equal turns
    at one place (conv_id, pos, role, text) are kept, each as a part of its own. Without records there are no rows."""
    spark, stage = records.sparkSession, Stage(records.sparkSession, "chat")
    path = f"{stage.folder}/formatted"
    with arrow_rows(spark, 1000):
        write_formatted(format_conversations(canonical_turns(records, column)), path)
    return read_written(spark, path)

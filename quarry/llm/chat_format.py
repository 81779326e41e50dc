"""Chat formatting by schema fingerprints.

Each layout declares the nested field paths that it needs and those that may stand beside them. Of a record's paths those
that no layout knows are taken away, and the hash of the rest selects the mapping that turns the record into canonical
turns (conversation, turn, role, text); a hash that isn't in the table selects none, and the record is reported with its
fingerprint, the hash of all its paths. Tables of one layout are mapped with column expressions by their schema; a column
of JSON records of mixed layouts is mapped record by record. Turns are then marked up, with control strings inside texts
escaped reversibly, and assistant texts are put under the loss mask.

A conversation is read in order by one task, because digests over it are sequential, but it is never held: turns stream
through in sorted order and leave as pieces of bounded size, however long the conversation.

Defined results: null texts and roles are empty; turns of equal number are ordered by role, then text; rows without a
conversation id form one conversation. Fields that no layout knows change the fingerprint but not the turns; fields of
another layout make the record unknown unless its own declares them. A record of an unknown fingerprint, or that isn't
JSON, has no turns (its fingerprint is reported). A field that holds no text counts as its JSON, null as empty. Of a key
that repeats within an object the last counts. Marks of paths inside keys ('.', '[', a backslash) are escaped with a
backslash, so that no key can pass for a path. A lone surrogate, which no text in UTF-8 can hold, becomes U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Characters of formatted text in a piece, at least one turn.
PIECE_CHARS = 1 << 18
_SURROGATE = re.compile("[\ud800-\udfff]")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

_SINGLE = ("answer", "completion", "input", "instruction", "output", "prompt", "question", "response")
#: Layout -> the field paths it needs, and those of other layouts that may stand beside them; [] stands for the elements of an array.
LAYOUTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "turn_rows": (("role", "text"), _SINGLE),  # a table has conv_id and turn beside them
    "messages": (("messages[].content", "messages[].role"), ()),
    "from_value": (("conversations[].from", "conversations[].value"), ()),
    "prompt_completion": (("completion", "prompt"), ()),
    "prompt_response": (("prompt", "response"), ()),
    "instruction": (("instruction", "output"), ()),
    "instruction_input": (("input", "instruction", "output"), ()),
    "question_answer": (("answer", "question"), ()),
}
KNOWN = frozenset(p for needed, beside in LAYOUTS.values() for p in (*needed, *beside))
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: (layout -> fields of one user text, joined by an empty line, and the assistant's field)
_PAIRS = {"prompt_completion": (("prompt",), "completion"), "prompt_response": (("prompt",), "response"), "instruction": (("instruction",), "output"), "instruction_input": (("instruction", "input"), "output"), "question_answer": (("question",), "answer")}
_LISTS = {"messages": ("messages", "role", "content"), "from_value": ("conversations", "from", "value")}


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of all nested field paths of a record."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()


#: Fingerprint of known paths -> layout: one for each choice among the paths that may stand beside a layout's own.
BY_PRINT: dict[str, str] = {fingerprint((*needed, *some)): name for name, (needed, beside) in LAYOUTS.items() for n in range(len(beside) + 1) for some in combinations(beside, n)}


def layout_of(paths: set[str]) -> str | None:
    """The layout that the hash of the known paths selects."""
    return BY_PRINT.get(fingerprint(paths & KNOWN))


def _below(at: str | None, key: str) -> str:
    own = re.sub(r"[\\.\[\]]", r"\\\g<0>", key)
    return own if at is None else f"{at}.{own}"


def schema_paths(kind: T.DataType, at: str | None = None) -> set[str]:
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, _below(at, f.name))}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at or ""}


def json_paths(value: dict) -> set[str]:
    """Paths of all leaves; an empty object or array has none."""
    found: set[str] = set()
    stack: list[tuple[Any, str | None]] = [(value, None)]
    while stack:
        v, at = stack.pop()
        if isinstance(v, dict):
            stack += [(x, _below(at, k)) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(x, f"{at}[]") for x in v]
        else:
            found.add(at or "")
    return found


def layout_of_schema(schema: T.StructType) -> str | None:
    return layout_of(schema_paths(schema))


def _record(line: str | None) -> dict | None:
    try:
        record = json.loads(line) if line else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def fingerprint_of_json(line: str | None) -> str | None:
    record = _record(line)
    return None if record is None else fingerprint(json_paths(record))


def _text(value: Any) -> str:
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _SURROGATE.sub("\ufffd", text)


def _turns(record: dict, layout: str | None) -> list[tuple[str, str]]:
    if layout == "turn_rows":
        return [(_text(record["role"]), _text(record["text"]))]
    if layout in _LISTS:
        field, role, text = _LISTS[layout]
        return [(ROLES.get(_text(m.get(role)), _text(m.get(role))), _text(m.get(text))) for m in record[field] if isinstance(m, dict)]
    if layout in _PAIRS:
        asked, answer = _PAIRS[layout]
        return [("user", "\n\n".join(filter(None, (_text(record[f]) for f in asked)))), ("assistant", _text(record[answer]))]
    return []


def turns_of_json(line: str | None) -> list[tuple[str, str]]:
    """(role, text) turns of one JSON record of any known layout."""
    record = _record(line)
    return [] if record is None else _turns(record, layout_of(json_paths(record)))


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string()), ("fingerprint", pa.string())])


def convert_records(df: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """Turns of a column of JSON records of any layouts: conv_id, turn (within the record), role, text, and the record's
    layout and fingerprint. A record without turns has one row with a null turn, so that no record is lost from sight."""

    def turns(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, line in rows:
            record = _record(line)
            paths = json_paths(record) if record is not None else None
            layout, key = (None, None) if paths is None else (layout_of(paths), fingerprint(paths))
            found = _turns(record, layout) if layout else []
            for i, (role, text) in enumerate(found):
                yield conv, i, role, text, layout, key
            if not found:
                yield conv, None, None, None, layout, key

    kind = "conv_id long, turn long, role string, text string, layout string, fingerprint string"
    return df.select(F.col(id_col).cast("long"), json_col).mapInArrow(lambda batches: _emit(turns(_consecutive(batches)), _TURNS), kind)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) rows of a table of one layout, chosen by its schema's fingerprint."""
    layout = layout_of_schema(df.schema)
    role = lambda c: F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[c], c, F.lit(""))
    if layout == "turn_rows":
        return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if layout in _LISTS:
        field, who, text = _LISTS[layout]
        each = df.select(F.col(id_col).cast("long").alias("conv_id"), F.posexplode(field).alias("turn", "m"))
        return each.select("conv_id", F.col("turn").cast("long"), role(F.col(f"m.{who}")).alias("role"), F.coalesce(f"m.{text}", F.lit("")).alias("text"))
    if layout in _PAIRS:
        asked, answer = _PAIRS[layout]
        parts: list[Column] = [F.when(F.col(f) != "", F.col(f)) for f in asked]
        pair = F.array(F.struct(F.lit("user").alias("role"), F.concat_ws("\n\n", *parts).alias("text")), F.struct(F.lit("assistant").alias("role"), F.coalesce(answer, F.lit("")).alias("text")))
        return df.select(F.col(id_col).cast("long").alias("conv_id"), F.posexplode(pair).alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), "m.role", "m.text")
    raise ValueError(f"no layout has the fingerprint {fingerprint(schema_paths(df.schema))}")


def escape(text: str) -> str:
    """No control string is left in it: every '<|' gets a second bar."""
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The marked-up turn, and where in it the loss mask lies."""
    head = f"{OPEN}{escape(role).replace('\n', '<|nl|>')}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", (len(head), len(head) + len(body)) if role == "assistant" else None


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text."""
    return [(unescape(role.replace("<|nl|>", "\n")), unescape(text)) for role, text in _TURN.findall(formatted)]


def _consecutive(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _emit(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64())))])


def format_conversations(turns: DataFrame) -> DataFrame:
    """Pieces of formatted conversations, in order within their partition: conv_id, piece, formatted, loss_spans (code points within the piece)."""

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, piece, parts, spans, size = None, 0, [], [], 0
        for conv, _, role, text in rows:
            if parts and (conv != now or size >= PIECE_CHARS):
                yield now, piece, "".join(parts), spans
                piece, parts, spans, size = piece + 1 if conv == now else 0, [], [], 0
            elif conv != now:
                piece = 0
            now = conv
            turn, mask = format_turn(role or "", text or "")
            if mask:
                spans.append([size + mask[0], size + mask[1]])
            parts.append(turn)
            size += len(turn)
        if parts:
            yield now, piece, "".join(parts), spans

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda batches: _emit(pieces(_consecutive(batches)), _PIECES), "conv_id long, piece long, formatted string, loss_spans array<array<long>>")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(pieces: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per conversation, read from formatted pieces. They are brought together and in order first, unless they come
    straight from format_conversations(), which leaves them so."""

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        now: tuple | None = None
        for conv, _, formatted, spans in rows:
            if now is None or now[0] != conv:
                if now:
                    yield _row(now)
                now = (conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0])
            turns = parse(formatted)
            for role, text in turns:
                now[1].update(f"{role}\n{text}\n".encode())
            now[3][0] += len(turns)
            for a, b in spans:
                masked = unescape(formatted[a:b])
                now[2].update(masked.encode())
                now[3][1] += len(masked)
            now[3][2] += len(formatted)
        if now:
            yield _row(now)

    def _row(x: tuple) -> tuple:
        return x[0], x[3][0], x[1].hexdigest(), x[3][1], x[2].hexdigest(), x[3][2]

    run: Callable = lambda batches: _emit(digests(_consecutive(batches)), _DIGESTS)
    if not ordered:
        pieces = pieces.select(*_PIECES.names).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

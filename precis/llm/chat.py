"""Chat formatting by columnar byte assembly.

Turns are sorted within their conversation and written, batch by batch, into one preallocated buffer: segment lengths,
their running sum and scatter indices come from numpy, and headers, contents and footers are copied by index. A
conversation comes out as one or more parts (text and loss spans); its parts joined are the formatted conversation,
so that memory stays bounded for conversations of any length.

Template: ``[INST] text [/INST]`` (user), ``<s>text</s>`` (assistant), ``<sys>`` line text line ``</sys>`` line (system)
and ``<role>name</role>text</turn>`` (any other role, a null one as an empty name). A control string inside a text or
a role name gets a backslash after its first character (one more, if it has some), which is taken off on reading.
The loss mask covers the assistants' texts."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, texts, utf8

KINDS = ("user", "assistant", "system")  # any other role: kind 3
HEAD = (b"[INST] ", b"<s>", b"<sys>\n", b"<role>")
MIDDLE = (b"", b"", b"", b"</role>")
FOOT = (b" [/INST]", b"</s>", b"\n</sys>\n", b"</turn>")
_NAMES = "s|INST|sys|role|turn"
_ESCAPE = rf"([<\[])(\\*)(/?(?:{_NAMES})[>\]])"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*/?(?:{_NAMES})[>\]])".encode())
PART_BYTES = 1 << 20


def _escaped(arr: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(arr.cast(pa.large_string()), ""), _ESCAPE, r"\1\2\\\3")


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1\2", text) if b"\\" in text else text


def _assemble(roles: pa.Array, contents: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns of a batch: kind, ends of the 5 segments of each turn, bytes, and first byte of each turn."""
    kind = np.full(len(roles), 3)
    for i, name in enumerate(KINDS):
        kind[pc.fill_null(pc.equal(roles, name), False).to_numpy(zero_copy_only=False)] = i
    sources = []
    for part in (HEAD, None, MIDDLE, contents, FOOT):
        if isinstance(part, tuple):
            size = np.array([len(x) for x in part])
            data = np.frombuffer(b"".join(part), np.uint8)
            start, size = (np.cumsum(size) - size)[kind], size[kind]
        else:
            data, offs = utf8(_escaped(roles if part is None else part))
            start, size = offs[:-1], np.diff(offs)
            if part is None:
                size = np.where(kind == 3, size, 0)
        sources.append((data, start, size))
    ends = np.cumsum(np.stack([s for _, _, s in sources], axis=1).ravel()).reshape(-1, 5)
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for i, (data, start, size) in enumerate(sources):
        out[ragged(ends[:, i] - size, size)] = data[ragged(start, size)]
    return kind, ends, out, np.concatenate(([0], ends[:-1, -1]))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, part, text, turns, loss_start, loss_size): parts of the formatted conversations; the last two are byte
    spans within the part.

    Rows of a conversation go by turn, null turns first, equal turns by role and text; repeated rows are turns of
    their own; null texts are empty; a null conversation id is an id; an empty table gives no parts."""
    schema = T.StructType([
        T.StructField("conv_id", turns.schema[conv_col].dataType), T.StructField("part", T.IntegerType()),
        T.StructField("text", T.StringType()), T.StructField("turns", T.IntegerType()),
        T.StructField("loss_start", T.ArrayType(T.IntegerType())),
        T.StructField("loss_size", T.ArrayType(T.IntegerType()))])

    def run(batches):
        last, part = object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            kind, ends, out, start = _assemble(b.column(1), b.column(2))
            code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new_id = np.concatenate(([True], code[1:] != code[:-1]))
            since = start - start[np.maximum.accumulate(np.where(new_id, np.arange(len(start)), 0))]
            step = since // part_bytes
            opens = np.flatnonzero(new_id | np.concatenate(([True], step[1:] != step[:-1])))
            numbers = []
            for i in opens.tolist():
                value = ids[i].as_py()
                part = part + 1 if value == last else 0
                last = value
                numbers.append(part)
            bounds = np.append(start[opens], len(out)).astype(np.int32)
            text = pa.StringArray.from_buffers(len(opens), pa.py_buffer(bounds), pa.py_buffer(out))
            spoken = np.flatnonzero(kind == 1)
            owner = np.searchsorted(opens, spoken, side="right") - 1
            lists = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(opens))))).astype(np.int32)
            first = (ends[spoken, 2] - bounds[owner]).astype(np.int32)
            size = (ends[spoken, 3] - ends[spoken, 2]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(opens)), pa.array(numbers, pa.int32()), text,
                 pa.array(np.diff(np.append(opens, len(start))).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(lists), pa.array(first)),
                 pa.ListArray.from_arrays(pa.array(lists), pa.array(size))], names=schema.names)

    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"),
                        F.col(turn_col).alias("_turn"))
    # one conversation lies in one partition, sorted; it streams through the task in batches
    dealt = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    return dealt.select("_conv", "_role", "_text").mapInArrow(run, schema)


def read_turns(part: bytes):
    """(role, text) of each turn of a formatted part, as bytes, unescaped."""
    at = 0
    while at < len(part):
        kind = next(i for i, h in enumerate(HEAD) if part.startswith(h, at))
        at += len(HEAD[kind])
        role = KINDS[kind].encode() if kind < 3 else None
        if role is None:
            end = part.index(MIDDLE[3], at)
            role, at = unescape(part[at:end]), end + len(MIDDLE[3])
        end = part.index(FOOT[kind], at)
        yield role, unescape(part[at:end])
        at = end + len(FOOT[kind])


def chat_digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``format_chats``'s parts as they stream by in order: turn count,
    hash of the turns, characters and hash of the text under the loss mask, formatted characters."""
    schema = T.StructType([parts.schema["conv_id"], T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()),
                           T.StructField("formatted_chars", T.LongType())])

    def run(batches):
        state, done = None, []

        def close():
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for b in batches:
            columns = (b.column(c) for c in ("conv_id", "part", "loss_start", "loss_size"))
            rows = zip(*(c.to_pylist() for c in columns), texts(b.column("text")))
            for conv, number, starts, sizes, text in rows:
                if number == 0:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(b"%b\n%b\n" % (role, said))
                for at, size in zip(starts, sizes):
                    said = unescape(text[at:at + size])
                    state[3] += len(said.decode())
                    state[4].update(said)
                state[5] += len(text.decode())
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*done), _arrow(schema))], names=schema.names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), _arrow(schema))], names=schema.names)

    return parts.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    return [to_arrow_type(f.dataType) for f in schema.fields]

"""Chat formatting by columnar byte assembly.

A conversation becomes one string of turns, each a header, the escaped text and an end mark:
system `<s>[SYS] text [/SYS]`, user `<s>[INST] text [/INST]`, assistant ` text</s>`, any other role `<s>[ROLE name] text [/ROLE]`.
Inside texts and role names `\\` becomes `\\\\`, `<` becomes `\\(` and `[` becomes `\\{`, in role names also `]` becomes `\\}`, so that no mark can occur in a text.
Segment lengths, cumulative offsets and scatter indices are computed in numpy, and headers and contents are copied
into one preallocated buffer, which becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiforge.llm.common import text_or_empty

_HEAD = {"system": b"<s>[SYS] ", "user": b"<s>[INST] ", "assistant": b" "}
_TAIL = {"system": b" [/SYS]", "user": b" [/INST]", "assistant": b"</s>"}
_ESCAPES = (("\\", "\\\\"), ("<", "\\("), ("[", "\\{"))
_BACK = {"\\\\": "\\", "\\(": "<", "\\{": "[", "\\}": "]"}
_TURN = re.compile(r"<s>\[SYS\] (?P<system>[^<\[]*) \[/SYS\]|<s>\[INST\] (?P<user>[^<\[]*) \[/INST\]|<s>\[ROLE (?P<role>[^<\[\]]*)\] (?P<other>[^<\[]*) \[/ROLE\]| (?P<assistant>[^<\[]*)</s>")
_FORMATTED = "conv_id long, formatted string, loss_start array<long>, loss_end array<long>"


def _escaped(column: pa.Array) -> pa.Array:
    for plain, safe in _ESCAPES:
        column = pc.replace_substring(column, plain, safe)
    return column


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its rows' offsets, from 0."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _marks(roles: list[str | None]) -> tuple[pa.Array, pa.Array]:
    named = {r: _escaped(pa.array([r or ""]))[0].as_py().replace("]", "\\}").encode() for r in set(roles)}
    kinds = {r: (_HEAD[r], _TAIL[r]) if r in _HEAD else (b"<s>[ROLE " + named[r] + b"] ", b" [/ROLE]") for r in named}
    return pa.array([kinds[r][0] for r in roles], pa.binary()).cast(pa.string()), pa.array([kinds[r][1] for r in roles], pa.binary()).cast(pa.string())


def assemble(ids: np.ndarray, roles: list[str | None], texts: pa.Array) -> pa.RecordBatch:
    """Turns in order, those of a conversation together -> one row for each conversation.

    loss_start and loss_end are code points in formatted: the contents of assistant turns, without header and end mark.
    """
    n = len(ids)
    heads, tails = _marks(roles)
    parts = [_bytes_of(x) for x in (heads, _escaped(texts), tails)]
    lengths = np.stack([np.diff(at) for _, at in parts], axis=1)
    starts = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(int(starts[-1]), dtype=np.uint8)
    for k, (data, at) in enumerate(parts):
        # a byte's place: its place in its own column, shifted by what stands before its segment in the output
        shift = np.repeat(starts[k:-1:3] - at[:-1], lengths[:, k])
        out[np.arange(len(data)) + shift] = data
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if n else np.zeros(0, dtype=np.int64)
    bounds = np.concatenate([starts[3 * first], starts[-1:]]).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    conversation = np.searchsorted(first, np.arange(n), side="right") - 1
    mine = np.array([r == "assistant" for r in roles], dtype=bool)
    zero = points[bounds[:-1]][conversation] if n else np.zeros(0, dtype=np.int64)
    begin, end = (points[starts[1:-1:3]] - zero)[mine] if n else zero, (points[starts[2::3]] - zero)[mine] if n else zero
    at = np.concatenate([[0], np.cumsum(np.bincount(conversation[mine], minlength=len(first)))]).astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int64))) for x in (begin, end)]
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), formatted.cast(pa.string()), *spans], names=["conv_id", "formatted", "loss_start", "loss_end"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, formatted, loss_start, loss_end, one row a conversation.

    Turns are ordered by turn, ties by role and text; repeated rows stay; nulls sort first; null text counts as empty, a null
    role as one without a name; rows without conv_id are left out, having no conversation. Other columns are ignored.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), "role", text_or_empty().alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if kept and (cut or kept[-1].column(0)[0].as_py() != ids[0]):
                yield whole([*kept, b.slice(0, cut)])
                kept = []
            elif cut:
                yield whole([b.slice(0, cut)])
            kept.append(b.slice(cut))
        if kept:
            yield whole(kept)

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        return assemble(t.column(0).to_numpy(), t.column(2).to_pylist(), pa.concat_arrays(t.column(3).chunks) if t.num_rows else pa.array([], pa.string()))

    return ordered.mapInArrow(run, _FORMATTED)


def unescaped(text: str) -> str:
    return re.sub(r"\\[\\({}]", lambda m: _BACK[m[0]], text)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        kind = m.lastgroup if m.lastgroup != "other" else "role"
        role = unescaped(m["role"]) if kind == "role" else kind
        found.append((role, unescaped(m["other"] if kind == "role" else m[kind])))
        at = m.end()
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from formatted alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, begin, end in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                turns = turns_of(text)
                loss = "".join(unescaped(text[s:e]) for s, e in zip(begin, end, strict=True))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((i, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

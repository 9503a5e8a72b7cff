"""Chat formatting by columnar byte assembly.

Turns are dealt by conversation and sorted; a worker sees whole
conversations, batch by batch. Segment lengths, their running sums and the
scatter indices are numpy arrays, and headers and contents are copied into
one preallocated Arrow buffer.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside texts
and roles, ``<`` followed by any backslashes and ``|`` gets one backslash more,
so no control string can stand there and removing one restores the text; in
roles, backslash and newline are written ``\\\\`` and ``\\n`` first.

Defined results: a null text or role is empty; turns are ordered by turn (null
first), then role and text; repeated rows are turns each; rows without conv_id
are one conversation; no rows give no conversations; only the four named
columns are read, so names of others can't clash. A conversation is one value,
so one task holds all of its turns, and it may have 2 GB at most, the bound of
a string; a longer one is an error that names it.
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

from kinfold.llm import wordhash as W

#: Bytes of formatted conversations in an Arrow batch, at most (a single one may be longer), and in a conversation.
BATCH_BYTES, MOST_BYTES = 64 << 20, (1 << 31) - 1
HEAD, BREAK, TAIL = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LEARNED = "assistant"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def escape_roles(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations (turns first[c] to first[c + 1]), and by turn the place of its text in bytes and its length."""
    role_bytes, role_at = W.bytes_of(escape_roles(roles))
    text_bytes, text_at = W.bytes_of(escape(texts))
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    size = len(HEAD) + n_role + len(BREAK) + n_text + len(TAIL)
    at = np.concatenate(([0], np.cumsum(size)))
    buffer = pa.allocate_buffer(int(at[-1]))
    out = np.frombuffer(buffer, np.uint8)
    role_to = at[:-1] + len(HEAD)
    text_to = role_to + n_role + len(BREAK)
    for piece, to in ((HEAD, at[:-1]), (BREAK, text_to - len(BREAK)), (TAIL, text_to + n_text)):
        out[to[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    out[W.ranges(role_to, n_role)] = role_bytes
    out[W.ranges(text_to, n_text)] = text_bytes
    begin = at[first]
    made = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(begin), buffer)
    return made, text_to - np.repeat(begin[:-1], np.diff(first)), n_text


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted turns as tables of whole conversations, with each one's first turn and the total."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        ids = batch.column("conv_id")
        if held[:-1] and ids[0].equals(held[0].column("conv_id")[0]) and ids[-1].equals(ids[0]):
            continue  # one conversation goes on
        table = pa.concat_tables(held).combine_chunks()
        edge = _edges(table)
        if len(edge) > 2:
            yield table.slice(0, edge[-2]), edge[:-1]
        held = [table.slice(edge[-2])]
    if held:
        table = pa.concat_tables(held).combine_chunks()
        yield table, _edges(table)


def _edges(table: pa.Table) -> np.ndarray:
    ids = table.column("conv_id").combine_chunks()
    empty = ids.is_null().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy(zero_copy_only=False)
    turn = (np.diff(value) != 0) | (np.diff(empty.astype(np.int8)) != 0)
    return np.concatenate(([0], np.flatnonzero(turn) + 1, [len(value)]))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = LEARNED) -> DataFrame:
    """By conversation: conv_id, n_turns, formatted, and loss_spans (start and length in UTF-8 bytes of every text of the role ``learned``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole(batches):
            roles, texts = W.as_strings(table.column("role")), W.as_strings(table.column("text"))
            made, to, length = assemble(roles, texts, first)
            mask = pc.equal(roles, learned).to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(mask)))[first]
            starts, lengths = to[mask], length[mask]
            ids = table.column("conv_id").combine_chunks().take(pa.array(first[:-1]))
            for lo, part in W.slices(made, BATCH_BYTES):
                hi = lo + len(part)
                if len(part) == 1 and pc.binary_length(part)[0].as_py() > MOST_BYTES:
                    raise ValueError(f"conversation {ids[lo].as_py()} has more than {MOST_BYTES} bytes")
                own = slice(upto[lo], upto[hi])
                spans = pa.StructArray.from_arrays([pa.array(starts[own]), pa.array(lengths[own])], names=["start", "length"])
                spans = pa.ListArray.from_arrays(pa.array((upto[lo : hi + 1] - upto[lo]).astype(np.int32)), spans).cast(_SPANS)
                yield pa.record_batch([ids.slice(lo, len(part)), pa.array(np.diff(first)[lo:hi]), part.cast(pa.string()), spans], names=["conv_id", "n_turns", "formatted", "loss_spans"])

    own = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return own.mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, length: long>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, from the formatted conversation alone."""
    out = []
    for turn in formatted.split(HEAD.decode())[1:]:
        role, _, rest = turn.partition("\n")
        out.append((unescape_role(role), unescape(rest.removesuffix(TAIL.decode()))))
    return out


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what stands in formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns, raw = parse(text), text.encode()
                loss = "".join(unescape(raw[s["start"] : s["start"] + s["length"]].decode()) for s in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

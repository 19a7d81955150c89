"""Chat formatting by columnar byte assembly.

A conversation becomes one string of turns

    ### {role}\\n{text}</turn>\\n

in which roles and texts carry a backslash before each \\, # and < (and before
the line feed of a role), so that no control string can arise inside them and
the text can be read back.  A whole Arrow batch is laid out at once: lengths of
all segments, their cumulative offsets, then scatter indices of the copied
bytes into one preallocated buffer.

Rows of a conversation are dealt to one task by conv_id and sorted by turn
there; a conversation longer than a batch leaves in several pieces, so that no
task ever holds a whole one.  Turns with equal numbers go by role, then text.

Nulls and oddities: a null text or role is an empty one; a null conv_id is a
conversation of its own; a null turn comes first; repeated rows are repeated
turns; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import SLICE_BYTES, utf8_of

HEAD, ROLE_END, TURN_END, ESCAPE = b"### ", b"\n", b"</turn>\n", ord("\\")
SPECIAL = {"text": b"\\#<", "role": b"\\#<\n"}
ESCAPED = {k: np.isin(np.arange(256), list(v)) for k, v in SPECIAL.items()}
TURN = re.compile(rb"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


class Segment:
    """A column of byte strings with its escapes: out_length[i] bytes each, once escaped."""

    def __init__(self, texts: pa.Array, kind: str):
        self.data, self.offsets = utf8_of(texts)
        special = ESCAPED[kind][self.data]
        self.sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(special, out=self.sums[1:])
        self.special = np.flatnonzero(special)
        self.out_length = np.diff(self.offsets) + self.sums[self.offsets[1:]] - self.sums[self.offsets[:-1]]

    def scatter(self, out: np.ndarray, starts: np.ndarray) -> None:
        """Copy every string to its place in ``out``, a backslash before each special byte."""
        owner_shift = starts - self.offsets[:-1] - self.sums[self.offsets[:-1]]
        places = np.arange(len(self.data)) + self.sums[1:] + np.repeat(owner_shift, np.diff(self.offsets))
        out[places] = self.data
        out[places[self.special] - 1] = ESCAPE


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, turn offsets, text starts, text ends) of the formatted turns."""
    role, text = Segment(roles, "role"), Segment(texts, "text")
    lengths = len(HEAD) + role.out_length + len(ROLE_END) + text.out_length + len(TURN_END)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    buffer = np.empty(offsets[-1], np.uint8)
    role_at = offsets[:-1] + len(HEAD)
    text_at = role_at + role.out_length + len(ROLE_END)
    text_to = text_at + text.out_length
    for fixed, at in ((HEAD, offsets[:-1]), (ROLE_END, text_at - len(ROLE_END)), (TURN_END, text_to)):
        buffer[(at[:, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), len(at))
    role.scatter(buffer, role_at)
    text.scatter(buffer, text_at)
    return buffer, offsets, text_at, text_to


def format_chats(conversations: DataFrame, loss_role: str = "assistant", partitions: int | None = None) -> DataFrame:
    """(conv_id, piece, formatted, loss_starts, loss_ends) of each conversation.

    The pieces of a conversation, in order and joined, are its formatted text;
    most have one.  ``loss_starts`` and ``loss_ends`` are the byte ranges within
    the piece that the loss is taken over: each text of ``loss_role`` once.
    """
    conv_type = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", "role", "text")
    dealt = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, piece = object(), 0
        for batch in batches:
            for part in sized(batch):
                ids = part["conv_id"].to_pylist()
                buffer, offsets, starts, ends = assemble(part["role"], part["text"])
                loss = np.array([r == loss_role for r in part["role"].to_pylist()], bool)
                first = [i for i, c in enumerate(ids) if i == 0 or c != ids[i - 1]]
                bounds = np.array([*first, len(ids)])
                pieces = []
                for k, i in enumerate(first):
                    piece = piece + 1 if k == 0 and ids[i] == previous else 0
                    pieces.append(piece)
                previous = ids[-1]
                string_ends = offsets[bounds]
                formatted = pa.Array.from_buffers(
                    pa.string(), len(first), [None, pa.py_buffer(string_ends.astype(np.int32)), pa.py_buffer(buffer)]
                )
                chosen = np.flatnonzero(loss)
                list_ends = np.concatenate([[0], np.cumsum(loss)])[bounds]
                shift = np.repeat(string_ends[:-1], np.diff(list_ends))
                spans = [pa.ListArray.from_arrays(pa.array(list_ends, pa.int32()), pa.array(x[chosen] - shift)) for x in (starts, ends)]
                yield pa.record_batch(
                    [part["conv_id"].take(pa.array(first)), pa.array(pieces, pa.int64()), formatted, *spans],
                    ["conv_id", "piece", "formatted", "loss_starts", "loss_ends"],
                )

    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        run, f"conv_id {conv_type}, piece bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"
    )


def sized(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each."""
    sizes = np.diff(utf8_of(batch["text"])[1])
    block = np.concatenate([[0], np.cumsum(sizes)[:-1] // SLICE_BYTES]) if len(sizes) else sizes
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def unescape(raw: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", raw, flags=re.DOTALL)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of a formatted piece."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at byte {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the pieces: counts and digests of turns and of the text under the loss mask.

    Takes the rows as ``format_chats`` lays them out, the pieces of a
    conversation one after the other in a task; a digest is carried from piece
    to piece, so memory stays at one batch.
    """
    conv_type = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            columns = zip(*(batch[c].to_pylist() for c in ("conv_id", "piece", "formatted", "loss_starts", "loss_ends")), strict=True)
            for conv, piece, text, starts, ends in columns:
                if piece == 0:
                    if now:
                        done.append(now)
                    now = {"conv_id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                raw = text.encode()
                for role, said in parse(raw):
                    now["n"] += 1
                    now["turns"].update(role + b"\n" + said + b"\n")
                for a, b in zip(starts, ends, strict=True):
                    said = unescape(raw[a:b])
                    now["chars"] += len(said.decode())
                    now["loss"].update(said)
                now["all"] += len(text)
            if done:
                yield rows(done)
        if now:
            yield rows([now])

    def rows(done: list[dict]) -> pa.RecordBatch:
        return pa.record_batch(
            [
                pa.array([d["conv_id"] for d in done], schema_type),
                pa.array([d["n"] for d in done], pa.int64()),
                pa.array([d["turns"].hexdigest() for d in done]),
                pa.array([d["chars"] for d in done], pa.int64()),
                pa.array([d["loss"].hexdigest() for d in done]),
                pa.array([d["all"] for d in done], pa.int64()),
            ],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    schema_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[conv_type]
    return formatted.mapInArrow(
        run, f"conv_id {conv_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def with_planted(conversations: DataFrame) -> DataFrame:
    """The conversations plus conversation -7, whose texts look like the template."""
    said = "\\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more.select(*[F.col(c).cast(conversations.schema[c].dataType).alias(c) for c in more.columns]))

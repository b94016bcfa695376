"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>[INST] role [/INST]`` + newline + text + ``</s>`` + newline. Control
strings inside roles and texts are escaped with a backslash, so the marks in the output
are the template's own and the turns can be read back.

A conversation's rows are brought together in turn order by one shuffle and streamed:
each Arrow batch is assembled at once. Lengths of all segments give offsets, offsets give
the place of every byte, and headers, texts and ends are scattered into one preallocated
buffer that becomes the Arrow column. A long conversation is given out in blocks, so
memory is bounded by a batch and not by a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from recollect.llm._text import buffers, slices, string_column

OPEN, ROLE_OPEN, ROLE_CLOSE, CLOSE = "<s>", "[INST] ", " [/INST]\n", "</s>\n"
_CONTROL = r"(<|\[)(/?(?:s>|INST\]))"
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.S)
#: Bytes assembled at a time; scatter indices take eight bytes for each.
BLOCK_BYTES = 4_000_000

BLOCK_SCHEMA = (
    "conv_id long, block long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
)


def escape(texts: pa.Array) -> pa.Array:
    """Double backslashes; set one behind the bracket of a control string."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    return pc.replace_substring_regex(texts, _CONTROL, r"\1\\\2")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _scatter(out: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copy segment i of ``data`` to ``out[at[i]:]``."""
    for first, last in slices(offsets, BLOCK_BYTES):
        lo, hi = offsets[first], offsets[last]
        if last - first == 1:
            out[at[first] : at[first] + hi - lo] = data[lo:hi]
            continue
        move = np.repeat(at[first:last] - offsets[first:last], np.diff(offsets[first : last + 1]))
        out[np.arange(lo, hi) + move] = data[lo:hi]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, byte offsets of turns, code points before each text, its code points).

    ``roles`` and ``texts`` are large_string arrays without nulls. Code points count from
    the start of the turn.
    """
    kinds = pc.dictionary_encode(roles)
    heads = pa.array([OPEN + ROLE_OPEN + r + ROLE_CLOSE for r in escape(kinds.dictionary).to_pylist()], pa.large_string())
    head = heads.take(kinds.indices)
    body = escape(texts)
    head_at, head_data = buffers(head)
    body_at, body_data = buffers(body)
    n_head, n_body, end = np.diff(head_at), np.diff(body_at), np.frombuffer(CLOSE.encode(), np.uint8)
    turns = np.concatenate([[0], np.cumsum(n_head + n_body + len(end))])
    out = np.empty(turns[-1], np.uint8)
    _scatter(out, turns[:-1], head_at, head_data)
    _scatter(out, turns[:-1] + n_head, body_at, body_data)
    out[(turns[1:] - len(end))[:, None] + np.arange(len(end))] = end
    return out, turns, pc.utf8_length(head).to_numpy().astype(np.int64), pc.utf8_length(body).to_numpy().astype(np.int64)


def _format(train_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = object(), 0
        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            if not ids:
                continue
            roles, texts = string_column(batch, "role"), string_column(batch, "text")
            offsets = buffers(texts)[0]
            for lo, hi in slices(offsets, BLOCK_BYTES):
                data, turns, head, body = assemble(roles.slice(lo, hi - lo), texts.slice(lo, hi - lo))
                own = ids[lo:hi]
                starts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1])]
                ends = [*starts[1:], len(own)]
                chars = np.concatenate([[0], np.cumsum(head + body + len(CLOSE))])
                learn = pc.equal(roles.slice(lo, hi - lo), train_role).to_numpy(zero_copy_only=False)
                blocks, loss = [], ([], [])
                for a, b in zip(starts, ends, strict=True):
                    block = block + 1 if own[a] == last else 0
                    last = own[a]
                    blocks.append(block)
                    at = np.flatnonzero(learn[a:b]) + a
                    begin = chars[at] - chars[a] + head[at]
                    loss[0].append(begin)
                    loss[1].append(begin + body[at])
                formatted = pa.LargeStringArray.from_buffers(
                    len(starts), pa.py_buffer(np.concatenate([turns[starts], turns[-1:]])), pa.py_buffer(data)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own[a] for a in starts], pa.int64()),
                        pa.array(blocks, pa.int64()),
                        pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                        formatted.cast(pa.string()),
                        *(pa.array(x, pa.list_(pa.int64())) for x in loss),
                    ],
                    ["conv_id", "block", "n_turns", "formatted", "loss_starts", "loss_ends"],
                )

    return run


def format_conversations(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Formatted conversations as blocks of whole turns; see BLOCK_SCHEMA.

    Rows are ordered by turn (null first), ties by role and text; a repeated row is a turn
    of its own. Blocks of a conversation are numbered from 0, follow each other within a
    partition, and together are its text; loss spans are code points in the block, end
    exclusive, over the escaped texts of ``train_role``. Null roles and texts are empty;
    rows with a null conv_id form one conversation. Other columns are not read. No rows,
    no blocks.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format(train_role), BLOCK_SCHEMA)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done: list[tuple] = []
    open_: list = []

    def close() -> None:
        if open_:
            conv, n, turns, chars, loss, size = open_
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            open_.clear()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] == 0:
                close()
                open_[:] = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["formatted"]
            for role, said in read_back(text):
                open_[1] += 1
                open_[2].update(f"{role}\n{said}\n".encode())
            for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                learned = unescape(text[a:b])
                open_[3] += len(learned)
                open_[4].update(learned.encode())
            open_[5] += len(text)
        if done:
            yield batch_of(done)
            done.clear()
    close()
    if done:
        yield batch_of(done)


def digests(blocks: DataFrame) -> DataFrame:
    """One row per conversation, from the output of format_conversations alone: its turns and the
    text under its loss mask are read back and hashed. Streams block after block."""
    return blocks.mapInArrow(_digest, DIGEST_SCHEMA)

"""Packing into windows by Karmarkar-Karp multiway differencing.

Every text is encoded and closed with an end id. A text that fits a window stays
one piece. A longer one, which must be cut anyway, gives whole windows, and what
is left of it gives pieces of ``piece`` ids that help to even the windows out.
Pieces are taken in groups worth ``group_windows`` windows. In a group each piece
begins as a partial partition with one filled part; the two partitions with the
largest imbalance are merged with opposing order, largest part on smallest,
until one partition is left. Its parts are the windows, of near-equal size.
Where the largest exceeds the capacity, the group is partitioned again with one
window more.

A group is closed a little below the capacity of its windows, by cutting its
last piece: of the texts that fit a window, one a group at most is cut. Groups are
formed within the input partitions: nothing is shuffled, and memory is bounded by
one Arrow batch and one group. Only the last group of a partition can be small.

Texts with a run of over ``LONG_RUN`` white-space characters are encoded by
``tokenizers`` itself, which takes runs of any length; the faster encoder of all
others, whose ids are the same, can't backtrack through a run of a million.

Edge cases: null text counts as empty, and an empty text is its end id alone.
An added token of the vocabulary that occurs in a text gives its own id.
Ids may be null or repeated: every row is a document of its own. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

WINDOW, PIECE, GROUP_WINDOWS, SLACK, LONG_RUN = 2048, 64, 128, 15, 10_000


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def byte_bpe(path: str, pattern: str) -> Callable[[str], list[int]]:
    """The encoder of a byte-level BPE vocabulary file; special strings are ordinary text."""
    return _encoding(path, pattern).encode_ordinary


def with_added_tokens(path: str, pattern: str) -> Callable[[str], list[int]]:
    """The encoder of a byte-level BPE vocabulary file; text is split at its added tokens, which give their own ids."""
    plain, long_run = functools.partial(_encoding(path, pattern).encode, allowed_special="all"), re.compile(r"\s{%d}" % LONG_RUN)

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and long_run.search(text):
            return _tokenizer(path).encode(text, add_special_tokens=False).ids
        return plain(text)

    return encode


def differencing(sizes: list[int], parts: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of sizes in each of the parts, of near-equal sums."""
    heap = [(-size, k, [(size, k)] + [(0, None)] * (parts - 1)) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = [(x + y, s if t is None else t if s is None else (s, t)) for (x, s), (y, t) in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], turn, merged))
        turn += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        found, todo = [], [] if tree is None else [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                found.append(x)
        out.append(sorted(found))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts none of which exceeds the capacity; as few as differencing allows."""
    parts = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, parts)
        if all(sum(sizes[k] for k in part) <= capacity for part in found):
            return [part for part in found if part]
        parts += 1


def cut(total: int, window: int, piece: int) -> list[int]:
    """Lengths: a text that fits a window as it is; else whole windows, then whole pieces and what is left."""
    if total <= window:
        return [total]
    whole, rest = divmod(total, window)
    return [window] * whole + [piece] * (rest // piece) + [rest % piece] * (rest % piece > 0)


def _pack(batches: Iterator, path: str, pattern: str, end_id: int, window: int, piece: int, group_windows: int, slack: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    encode = with_added_tokens(path, pattern)
    sequence, limit = TaskContext.get().partitionId() << 32, group_windows * (window - slack)
    rows, group, held = [], [], 0  # rows: (id, start, ids, doc's ids, sequence, offset)

    def emit() -> pa.RecordBatch:
        nonlocal rows
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        rows = []
        return pa.RecordBatch.from_arrays(columns, names=["id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

    def close() -> None:
        nonlocal group, held, sequence
        for part in windows([len(x[2]) // 4 for x in group], window):
            at = 0
            for k in part:
                rows.append((*group[k], sequence, at))
                at += len(group[k][2]) // 4
            sequence += 1
        group, held = [], 0

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py() or "")
            ids.append(end_id)
            data, total, at = np.array(ids, dtype="<u4").tobytes(), len(ids), 0
            for n in cut(total, window, piece):
                if n == window < total:
                    rows.append((doc, at, data[4 * at : 4 * (at + n)], total, sequence, 0))
                    sequence += 1
                    at += n
                    continue
                while n:
                    take = min(n, limit - held)
                    group.append((doc, at, data[4 * at : 4 * (at + take)], total))
                    held, at, n = held + take, at + take, n - take
                    if held == limit:
                        close()
            if len(rows) >= 1024:
                yield emit()
    if group:
        close()
    if rows:
        yield emit()


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, window: int = WINDOW, piece: int = PIECE, group_windows: int = GROUP_WINDOWS, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    slack: ids that a group leaves free in each window, on average.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(lambda batches: _pack(batches, vocabulary, pattern, end_id, window, piece, group_windows, slack), "id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.select(F.col("id").alias(id_col), "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")

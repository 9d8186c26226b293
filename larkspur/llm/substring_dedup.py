"""Substring dedup by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes: each byte shifts the 32-bit hash by
one and adds the byte's gear value, so the hash is that of the last 32 bytes. A
chunk ends where the top bits of the hash are zero (after ``least`` bytes, and
at ``most`` at the latest). Boundaries depend on content, so an insertion moves
only the boundaries next to it, and a passage gives the same chunks in every
text. Chunks are named by a 128-bit XXH3 digest; of equal ones, the first by
(id, row, place) stays and the others are repeats. Adjacent repeats of a row
form a span; spans of at least ``min_span`` bytes are reported.

Texts are read once. A batch of rows is one record with its chunk lengths and
distinct digests. Each batch sends a digest once to the part that owns its range, however
often it occurs there, so a chunk that many rows share is no hot key; the part
replies to each batch with the places of its repeated digests and their first
occurrence. Texts are never shuffled; parts are bounded in size by their number.

Edge cases: null and empty texts have no chunks. Null ids come after all others
and stay null (2^63 - 1, which stands for none, can't be an id). Rows that repeat an id are rows of their own. A text longer than
a batch is a batch of its own. Empty tables give an empty result. Extra columns
are not read; ``drop_spans`` returns all columns.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import pack, pack_sorted, parts_of, ranges_of, raw, unpack, unpack_sorted
from .common import Scratch

LEAST, MASK_BITS, MOST, MIN_SPAN, BATCH_BYTES, KEYS_PER_PART, SEED = 12, 4, 192, 112, 12 << 20, 1_000_000, 11
NO_ID = (1 << 63) - 1
#: Rows of a batch, their chunks' lengths and digests: distinct ones in order, each chunk's place among them, how often each occurs and its first chunk.
BATCH = "batch long, ids binary, row_chunks binary, lengths binary, groups binary, keys binary, firsts binary, counts binary, n long"
SPANS = "id long, start long, end long, source_id long, source_ids array<long>"


@functools.lru_cache(maxsize=1)
def gears():
    import numpy as np

    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: bytes, least: int = LEAST, bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of data, the last one its length."""
    import numpy as np

    if not data:
        return []
    h = gears()[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # the hash of the last 2, 4, ... 32 bytes
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift)) if len(h) > shift else h[shift:]
    out, start, n = [], 0, len(data)
    for end in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist():
        while end - start > most:
            start += most
            out.append(start)
        if end - start >= least:
            out.append(end)
            start = end
    while n - start > most:
        start += most
        out.append(start)
    if start < n:
        out.append(n)
    return out


def _ids(values) -> bytes:
    """Signed ids, so that their order and the bytes they share survive packing."""
    import numpy as np

    return pack(np.ascontiguousarray(values, "<i8").view("<u8") ^ np.uint64(1 << 63))


def _read_ids(data: bytes):
    import numpy as np

    return (unpack(data).view("<u8") ^ np.uint64(1 << 63)).view("<i8")


def _layout(counts, lengths):
    """Of each chunk its row and its start in it."""
    import numpy as np

    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(lengths) - lengths
    first = (np.cumsum(counts) - counts)[row]
    return row, begin - begin[first]


def _chunk(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    from xxhash import xxh3_128_digest

    batch, size = TaskContext.get().partitionId() << 32, 0
    ids, counts, lengths, digests = [], [], [], []

    def record() -> pa.RecordBatch:
        nonlocal batch, size, ids, counts, lengths, digests
        row, start = _layout(np.array(counts, np.int64), np.array(lengths, np.int64))
        digest = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
        order = np.lexsort((start, row, np.array(ids, np.int64)[row], digest[:, 1], digest[:, 0]))
        new = _changes(digest[order])
        groups = np.empty(len(order), np.int64)
        groups[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        values = [batch, _ids(ids), pack(counts), pack(lengths), pack(groups), raw(digest[order][at], "<u8"), pack(order[at]), pack(np.diff(np.append(at, len(order)))), len(at)]
        batch, size = batch + 1, 0
        ids, counts, lengths, digests = [], [], [], []
        kinds = (pa.int64(), *[pa.binary()] * 7, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[x.split()[0] for x in BATCH.split(", ")])

    for rows in batches:
        for key, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            ends = boundaries(data)
            starts = [0, *ends[:-1]]
            ids.append(NO_ID if key is None else key)
            counts.append(len(ends))
            lengths.extend(np.subtract(ends, starts[: len(ends)]).tolist())
            digests.extend([xxh3_128_digest(data[a:b]) for a, b in zip(starts, ends, strict=False)])
            size += len(data)
            if size >= BATCH_BYTES:
                yield record()
    if ids:
        yield record()


def _changes(sorted_keys):
    """Where a row of sorted keys differs from the one before."""
    import numpy as np

    return np.concatenate(([True], (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1))) if len(sorted_keys) else np.empty(0, bool)


def _send(batches: Iterator, parts: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
    for rows in batches:
        for batch in rows.to_pylist():
            keys, ids = np.frombuffer(batch["keys"], "<u8").reshape(-1, 2), _read_ids(batch["ids"])
            row, start = _layout(unpack(batch["row_chunks"]), unpack(batch["lengths"]))
            first, n = unpack(batch["firsts"]), unpack(batch["counts"])
            out = []
            for part, a, b in ranges_of(keys[:, 0], parts):
                p = first[a:b]
                out.append((part, batch["batch"], a, raw(keys[a:b], "<u8"), pack(n[a:b]), _ids(ids[row[p]]), pack(row[p]), pack(start[p])))
            columns = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["part", "batch", "base", "keys", "n", "ids", "row", "start"])


def _resolve(table):
    """A part's replies: to each batch, the places of its repeated digests and their first occurrences."""
    import numpy as np
    import pyarrow as pa

    sent = sorted(table.to_pylist(), key=lambda r: r["batch"])
    keys = np.concatenate([np.frombuffer(r["keys"], "<u8").reshape(-1, 2) for r in sent])
    n, row, start = (np.concatenate([unpack(r[c]) for r in sent]) for c in ("n", "row", "start"))
    ids = np.concatenate([_read_ids(r["ids"]) for r in sent])
    sizes = np.array([len(r["keys"]) // 16 for r in sent])
    by = np.repeat(np.arange(len(sent)), sizes)
    order = np.lexsort((start, row, by, ids, keys[:, 1], keys[:, 0]))
    new = _changes(keys[order])
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    repeated = np.add.reduceat(n[order], at)[group] > 1
    source = np.full(len(keys), -1)
    source[order[repeated]] = order[at][group][repeated]
    out, begin = [], 0
    for r, size in zip(sent, sizes, strict=True):
        mine = source[begin : begin + size]
        some = np.flatnonzero(mine >= 0)
        s = mine[some]
        if len(some):
            out.append((r["batch"], pack_sorted(some + r["base"]), _ids(ids[s]), pack(start[s]), pack(row[s]), pack((s >= begin) & (s < begin + size))))
        begin += size
    kinds = (pa.int64(), *[pa.binary()] * 5)
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["batch", "places", "ids", "start", "row", "own"])


def _spans(batch_rows, replies, min_span: int):
    import numpy as np
    import pyarrow as pa

    names, kinds = [x.split()[0] for x in SPANS.split(", ")], [*[pa.int64()] * 4, pa.list_(pa.int64())]
    if not batch_rows.num_rows or not replies.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
    batch = batch_rows.to_pylist()[0]
    ids, lengths, groups, n = _read_ids(batch["ids"]), unpack(batch["lengths"]), unpack(batch["groups"]), batch["n"]
    row, start = _layout(unpack(batch["row_chunks"]), lengths)
    source_id, source_row, source_start, known = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool)
    for r in replies.to_pylist():
        p = unpack_sorted(r["places"])
        known[p], source_id[p], source_start[p] = True, _read_ids(r["ids"]), unpack(r["start"])
        source_row[p] = np.where(unpack(r["own"]) > 0, unpack(r["row"]), -1)  # -1: in another batch
    first = (source_row[groups] == row) & (source_start[groups] == start)
    repeated = known[groups] & ~first  # the first occurrence itself stays
    before = np.concatenate(([False], repeated[:-1] & (row[1:] == row[:-1])))
    after = np.concatenate((repeated[1:] & (row[1:] == row[:-1]), [False]))
    a, b = np.flatnonzero(repeated & ~before), np.flatnonzero(repeated & ~after)
    long = (start[b] + lengths[b] - start[a]) >= min_span
    a, b = a[long], b[long]
    plain = lambda x: None if x == NO_ID else x
    main, all_of = [], []
    for x, y in zip(a.tolist(), (b + 1).tolist(), strict=True):
        some, place = np.unique(source_id[groups[x:y]], return_inverse=True)
        size = np.bincount(place, lengths[x:y])
        main.append(plain(some[size.argmax()].item()))
        all_of.append([plain(i) for i in some[(size >= min_span) | (np.arange(len(some)) == size.argmax())].tolist()])
    columns = [[plain(i) for i in ids[row[a]].tolist()], start[a], start[b] + lengths[b], main, all_of]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def repeated_spans(docs: DataFrame, min_span: int = MIN_SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span of repeated chunks: id, start, end (bytes of the text's UTF-8), source_id (of its chunks' first occurrences, the row with most bytes, the smallest of equals) and source_ids (that and others with min_span bytes)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "chunks")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    batches = scratch.table(rows.mapInArrow(_chunk, BATCH), "batches")
    keys = batches.agg(F.sum("n")).first()[0] or 0
    parts = parts_of(keys, KEYS_PER_PART, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = batches.drop("groups").mapInArrow(lambda b: _send(b, parts), "part long, batch long, base long, keys binary, n binary, ids binary, row binary, start binary")
    replies = sent.repartition(parts, "part").groupBy("part").applyInArrow(_resolve, "batch long, places binary, ids binary, start binary, row binary, own binary")
    replies = scratch.table(replies, "replies")
    laid = batches.select("batch", "ids", "row_chunks", "lengths", "groups", "n")
    spans = laid.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(lambda a, b: _spans(a, b, min_span), SPANS)
    return spans.withColumnRenamed("id", id_col)


def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for rows in batches:
        out = []
        for text, spans in zip(rows.column(0), rows.column(1).to_pylist(), strict=True):
            data, kept, at = text.as_buffer().to_pybytes() if text.is_valid else b"", [], 0
            for s in spans or []:
                kept.append(data[at : s["start"]])
                at = max(at, s["end"])
            kept.append(data[at:])
            out.append(b"".join(kept).decode(errors="ignore") if text.is_valid else None)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), rows.column(2)], names=["__text", "__row"])


def drop_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans cut from the texts. Ids must be distinct; bytes of a character that a cut splits are dropped."""
    cuts = spans.groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    joined = docs.withColumn("__row", F.struct(*docs.columns)).join(cuts, F.col(id_col) == F.col("__id"), "left").select(F.col(text_col).alias("__text"), "__spans", "__row")
    kind = docs.select(F.struct(*docs.columns).alias("__row")).schema["__row"].dataType.simpleString()
    cut = joined.mapInArrow(_cut, f"__text string, __row {kind}")
    return cut.select(*(F.col("__text").alias(c) if c == text_col else F.col(f"__row.{c}").alias(c) for c in docs.columns))

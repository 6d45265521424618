"""Token ids in files: ids ranked by frequency, in a byte-aligned code with separate control bytes.

A file is Parquet, a row per document in ascending order of ``doc_id``: ``n_tokens``, ``control``
and ``data``. An id is stored as its place in the ranking of all ids by frequency (ties: smaller id
first), in one to four little-endian bytes of ``data``, so the common ids take one byte. ``control``
has two bits per id, its number of bytes less one, four ids to a byte. A decoder looks each control
byte up in a table of 256 x 4 lengths and gathers the bytes of all ids at once.

The ranking is a table of at most one row per id of the vocabulary. It is the one thing that goes
through the driver, and the vocabulary file bounds it (here 49,408 rows).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from skarn.llm.common import slices, table, written
from skarn.llm.vocab import default_path, encoder
from skarn.session import scratch_dir

#: Lengths of the four ids behind each control byte.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)


#: Ids coded at a time; more of them only if one document has more.
PORTION = 1 << 20


def _slots(n: np.ndarray) -> np.ndarray:
    """Place of each id of documents of ``n`` ids where every document begins a control byte of its own."""
    room = -(-n // 4) * 4
    return np.arange(int(n.sum())) + np.repeat((np.cumsum(room) - room) - (np.cumsum(n) - n), n)


def pack_many(ranks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, their number by document, data bytes and theirs, of ranks end to end (unsigned, below 2 ** 32)."""
    ranks = ranks.astype("<u4", copy=False)
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    controls = -(-n // 4)
    codes = np.zeros(int(controls.sum()) * 4, np.uint8)
    codes[_slots(n)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    upto = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    return control, controls, data, np.diff(upto[np.concatenate([[0], np.cumsum(n)])])


def unpack_many(n: np.ndarray, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ranks behind ``pack_many``, end to end: lengths from the table, then all bytes in one gather."""
    length = LENGTHS[control].reshape(-1)[_slots(n)]
    first = np.cumsum(length, dtype=np.int64) - length
    out = data[first].astype("<u4")
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        if len(longer):
            out[longer] |= data[first[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_ids(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of one document's ranks."""
    control, _, data, _ = pack_many(ranks, np.array([len(ranks)]))
    return control.tobytes(), data.tobytes()


def unpack_ids(n: int, control: bytes, data: bytes) -> np.ndarray:
    """The ranks behind ``pack_ids``."""
    return unpack_many(np.array([n]), np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8))


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and where each value begins and the last ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _values(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of values of the given lengths in bytes, laid end to end in ``data``."""
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _portions(batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    """The same rows, with about ``PORTION`` ids at a time; ``count`` gives the ids of each row."""
    for b in batches:
        if not b.num_rows:
            continue
        which = (np.cumsum(count(b)) - 1) // PORTION
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [b.num_rows]])
        for first, end in zip(bounds, bounds[1:]):
            yield b.slice(int(first), int(end - first))


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def token_ids(docs: DataFrame, path: str, end_id: int | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids, counts``: the ids of each whole text as little-endian bytes of the vocabulary's width.

    A null text counts as empty. ``end_id`` is appended unless it is None. The last row of a task has
    no ids but ``counts``, how often each id of the vocabulary occurs in its rows (64-bit integers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, names = encoder(path), ["key", "ids", "counts"]
        end = b"" if end_id is None else np.array([end_id], coder.kind).tobytes()
        seen, kind = np.zeros(coder.size, np.int64), None
        for b in slices(batches, 1024):
            ids = [x.tobytes() + end for x in coder.batch(b.column(1).to_pylist())]
            kind = b.column(0).type
            seen += np.bincount(np.frombuffer(b"".join(ids), coder.kind), minlength=coder.size)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(ids), pa.nulls(len(ids), pa.binary())], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), _binary([seen.tobytes()])], names)

    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {key_type}, ids binary, counts binary")


def ranking(tokens: DataFrame, size: int) -> np.ndarray:
    """Ids of a vocabulary of ``size`` in descending order of frequency over all documents."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in slices(batches, 16):
            for counts in b.column(0).to_pylist():
                seen += np.frombuffer(counts, np.int64)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], ["id", "n"])

    counts = tokens.select("counts").where("counts IS NOT NULL")
    totals = counts.mapInArrow(unfold, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    seen = np.zeros(size, np.int64)
    for row in totals.collect():  # a row per id of the vocabulary at most
        seen[row["id"]] = row["n"]
    return np.lexsort((np.arange(size), -seen))


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> tuple[str, np.ndarray]:
    """Write all documents; returns the folder and the ranking (place -> id).

    Texts are cut once and their ids counted; the ids wait in a written table for the ranking. Rows
    are dealt by ranges of ``doc_id`` before they are coded, as the ranges are found by a pass of their own.
    """
    coder = encoder(path)
    kind, size = coder.kind, coder.size
    tokens = written(token_ids(docs, path, end_id), "tokens")
    order = ranking(tokens, size)
    place = np.empty(size, "<u4")
    place[order] = np.arange(size)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in _portions(batches, lambda b: np.diff(_raw(b.column(1))[1]) // kind.itemsize):
            raw, at = _raw(b.column(1))
            n = np.diff(at) // kind.itemsize
            control, controls, data, sizes = pack_many(place[raw[at[0] : at[-1]].view(kind)], n)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n), _values(control, controls), _values(data, sizes),
                    pa.array(np.full(len(n), part, np.int32)), pa.array(starts, pa.int64()),
                ],
                ["doc_id", "n_tokens", "control", "data", "part", "local_start"],
            )

    key_type = tokens.schema["key"].dataType.simpleString()
    # Rows that share a key, or have none, may lie in several ranges: their order goes on to length and hash,
    # not to the ids, as the driver gets a sample of what the ranges are made of.
    order_by = ("key", F.length("ids"), F.xxhash64("ids"))
    rows = tokens.where("ids IS NOT NULL").select("key", "ids").repartitionByRange(*order_by).sortWithinPartitions(*order_by, "ids")
    folder = folder or scratch_dir(docs.sparkSession, "token-files")
    coded = rows.mapInArrow(code, f"doc_id {key_type}, n_tokens long, control binary, data binary, part int, local_start long")
    coded.write.option("compression", "zstd").parquet(folder)
    return folder, order


def read_token_files(spark, folder: str, order: np.ndarray, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) from the files alone.

    ``digest`` gives ``ids_crc32``, the unsigned crc32 of these bytes, in place of ``ids``.
    """
    stored = spark.read.parquet(folder)
    ids = order.astype("<u4")
    last = "ids_crc32 long" if digest else "ids binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches, lambda b: b.column("n_tokens").to_numpy()):
            n = b.column("n_tokens").to_numpy()
            (control, c), (data, d) = _raw(b.column("control")), _raw(b.column("data"))
            out = ids[unpack_many(n, control[c[0] : c[-1]], data[d[0] : d[-1]])].view(np.uint8)
            if digest:
                ends, view = np.cumsum(4 * n).tolist(), memoryview(out)
                column = pa.array([zlib.crc32(view[a:z]) for a, z in zip([0, *ends], ends)], pa.int64())
            else:
                column = _values(out, 4 * n)
            columns = [b.column("doc_id"), b.column("part"), b.column("local_start"), b.column("n_tokens"), column]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", last.split()[0]])

    key_type = stored.schema["doc_id"].dataType.simpleString()
    rows = stored.mapInArrow(decode, f"doc_id {key_type}, part int, local_start long, n_tokens long, {last}")
    # A row per file: what the files before it hold.
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", last.split()[0]
    )


def op9_token_files(spark, folder: str) -> DataFrame:
    """Contract of the query: see the module; a null text is empty and keeps its end id."""
    where, order = write_token_files(table(spark, folder, "documents"), default_path())
    return read_token_files(spark, where, order, digest=True)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())

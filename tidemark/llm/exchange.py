"""Keyed exchange: blocks of rows ask, in packed form, what is known about their keys in all other blocks.

The operators that look for repeated windows or colliding bands all need the same distributed step: every
block has many 64-bit keys, and wants to know for each whether it occurs in another block, and the least
value that it has anywhere. A row for each key would cost more in row headers than in keys, so a block
sends one row for each bucket of keys, holding sorted distinct keys as packed bytes. A key that is hot
occurs once in a block however often its rows repeat there, so no bucket grows with the copies of one key.
The replies come back by block in the order of the block's keys, one bit or two a key.

Blocks are checkpointed once, partitioned by their number; the joins with replies then move the replies
alone and leave the text where it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import checkpoint_ready, drop_held, fixed_partitions, release, shuffle_partitions
from tidemark.llm.textops import U, mix

BLOCK_BYTES = 4 << 20
SENT = "block long, bucket int, kind int, keys binary, low binary, least binary, most binary"
REPLY = "block long, bucket int, kind int, shared binary, less binary, value binary"
SENT_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), *((k, pa.binary()) for k in ("keys", "low", "least", "most"))])
REPLY_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), *((k, pa.binary()) for k in ("shared", "less", "value"))])


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def blocks_of(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload): rows of df in compressed blocks of about so many bytes, checkpointed by block number."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    n = shuffle_partitions(spark)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_pydict({"payload": pa.array([_pack(b) for b in t.to_batches()], pa.binary())})

        for b in batches:
            parts = max(1, -(-b.nbytes // block_bytes))
            step = max(1, -(-b.num_rows // parts))
            for a in range(0, b.num_rows, step):
                piece = b.slice(a, step)
                held.append(piece)
                size += piece.get_total_buffer_size() if parts == 1 and b.num_rows <= step else max(1, b.nbytes * piece.num_rows // max(1, b.num_rows))
                if size >= block_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    with fixed_partitions(spark):
        packed = df.mapInArrow(pack, "payload binary").select(F.monotonically_increasing_id().alias("block"), "payload")
        out = packed.repartition(n, "block").checkpoint(eager=True)
    release(spark)
    return out


def buckets(spark) -> int:
    """Key buckets; they follow spark.sql.shuffle.partitions, which is set by the size of the data."""
    return 2 * shuffle_partitions(spark)


class Keys:
    """The distinct keys of one block and one kind, dealt to buckets, in the order in which replies come back."""

    def __init__(self, keys: np.ndarray, n: int, low: np.ndarray | None = None, least: np.ndarray | None = None, most: np.ndarray | None = None):
        bucket = (mix(keys ^ U(0xA5A5A5A5)) % U(n)).astype(np.int32)
        by = (keys, bucket) if low is None else (low, keys, bucket)
        order = np.lexsort(by)
        k, b = keys[order], bucket[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (False if low is None else low[order][1:] != low[order][:-1])
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.of = np.empty(len(k), np.int64)  # distinct key of every entry
        self.of[order] = group
        self.keys, self.bucket = k[at], b[at]
        self.low = None if low is None else low[order][at]
        self.count = np.diff(np.append(at, len(k)))
        self.least = None if least is None or not len(at) else np.minimum.reduceat(least[order], at)
        self.most = None if most is None or not len(at) else np.maximum.reduceat(most[order], at)
        self.starts = np.searchsorted(self.bucket, np.arange(n + 1))

    def rows(self, block: int, kind: int = 0) -> pa.RecordBatch:
        full = np.flatnonzero(np.diff(self.starts))
        cut = lambda a: [b"" if a is None else a[self.starts[i] : self.starts[i + 1]].tobytes() for i in full]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(full), block, np.int64)), pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), *(pa.array(cut(a), pa.binary()) for a in (self.keys, self.low, self.least, self.most))], schema=SENT_ARROW)

    def replies(self, got: list[dict] | None, kind: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """For every distinct key: whether another block has it, whether with a lesser value; the least value anywhere if asked."""
        n = len(self.keys)
        shared, less = np.zeros(n, bool), np.zeros(n, bool)
        value = None if self.least is None else self.least.copy()
        for r in got or ():
            if r["kind"] == kind:
                a, b = self.starts[r["bucket"]], self.starts[r["bucket"] + 1]
                shared[a:b] = np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=b - a)
                if r["less"]:
                    less[a:b] = np.unpackbits(np.frombuffer(r["less"], np.uint8), count=b - a)
                if r["value"]:
                    value[a:b][shared[a:b]] = np.frombuffer(r["value"], np.int64)
        return shared, less, value


def _answer(values: bool) -> Callable[[pa.Table], pa.Table]:
    def answer(t: pa.Table) -> pa.Table:
        out = {k: [] for k in REPLY_ARROW.names}
        kind_of = t.column("kind").to_numpy()
        for kind in np.unique(kind_of):
            part = t.filter(pa.array(kind_of == kind))
            each = {k: part.column(k).to_pylist() for k in ("keys", "low", "least", "most")}
            sizes = np.array([len(x) // 8 for x in each["keys"]])
            flat = lambda k, d: np.frombuffer(b"".join(each[k]), d)  # noqa: E731, B023
            keys = flat("keys", np.uint64)
            low, least, most = (x if len(x) else None for x in (flat("low", np.uint32), flat("least", np.int64), flat("most", np.int64)))
            order = np.argsort(keys, kind="stable") if low is None else np.lexsort((low, keys))
            k = keys[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (False if low is None else low[order][1:] != low[order][:-1])
            at, group = np.flatnonzero(new), np.cumsum(new) - 1
            shared, less, value = np.empty(len(k), bool), None, None
            if most is not None:  # whether the values differ anywhere
                shared[order] = (np.minimum.reduceat(least[order], at) != np.maximum.reduceat(most[order], at))[group]
            else:
                shared[order] = (np.diff(np.append(at, len(k))) > 1)[group]
                if least is not None:
                    first = np.empty(len(k), np.int64)
                    first[order] = np.minimum.reduceat(least[order], at)[group]
                    less = first < least
                    value = first if values else None
            ends = np.cumsum(sizes)
            for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
                out["shared"].append(np.packbits(shared[a:b]).tobytes())
                out["less"].append(b"" if less is None else np.packbits(less[a:b]).tobytes())
                out["value"].append(b"" if value is None else value[a:b][shared[a:b]].tobytes())
            for c in ("block", "bucket", "kind"):
                out[c] += part.column(c).to_pylist()
        return pa.Table.from_pydict(out, schema=REPLY_ARROW)

    return answer


def ask(blocks: DataFrame, send: Callable[[int, bytes, list | None, int], Iterator[pa.RecordBatch]], values: bool = False, name: str = "r1") -> DataFrame:
    """Blocks with one more column of replies.

    send(block, payload, replies so far, buckets) yields Keys.rows. The replies of a block are bounded by its
    own keys; they are checkpointed before they are joined, so a lost executor costs one pass at most.
    """
    spark = blocks.sparkSession
    n = buckets(spark)
    before = [c for c in blocks.columns if c not in ("block", "payload")]

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                got = {c: row[c] for c in before}
                yield from send(row["block"], row["payload"], got, n)

    sent = blocks.mapInArrow(emit, SENT)
    replies = sent.groupBy("bucket").applyInArrow(_answer(values), REPLY)
    each = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "kind", "shared", "less", "value")).alias(name))
    with fixed_partitions(spark):
        each = each.checkpoint(eager=True)
    release(spark)
    return blocks.join(each.hint("shuffle_hash"), "block", "left")

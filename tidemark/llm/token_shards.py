"""Token-id output: raw id payloads in shards, with a minimal perfect hash index from keys to offsets.

A shard holds the documents of one range of keys, in ascending order. It is one file:

    magic "TIDESHRD", then eight little-endian 64-bit counts: version, bytes for each id (2 or 4), documents,
    ids, index slots, hash levels, blocks of level bits, and the end id;
    payload: the ids, end id after each document, raw; starts: documents + 1 offsets (uint64, in ids);
    keys: the documents' keys (int64); index: level sizes (uint64); blocks of 512 level bits, each after the
    number of set bits before it (uint32); and for every slot a 32-bit fingerprint of its key and the place
    of its document (uint32).

The minimal perfect hash puts each key to the first level where no other key fell on its bit; a slot is
the number of set bits before it. A lookup seeks to one block for each level it tries, to a slot, to two offsets and
to the ids, however many keys there are. Keys that are not there are told by the fingerprint (but for 1 in 2**32).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import checkpoint_ready, cut, held, shuffle_partitions
from tidemark.llm.textops import U, mix, text_bytes
from tidemark.llm.wordpieces import PackedTable, vocabulary_path

MAGIC = b"TIDESHRD"
GAMMA = 2
NULL_KEY = np.iinfo(np.int64).min
BLOCK = np.dtype([("rank", "<u4"), ("bits", "u1", 64)])
ENTRY = np.dtype([("mark", "<u4"), ("place", "<u4")])
SLICE = 1 << 21  # ids read at once


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.view(np.uint64) ^ U((level * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ U(0xF1357AEA2E62A9C5)) >> U(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: a slot below their number for each."""

    def __init__(self, sizes: np.ndarray, blocks: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.blocks = blocks  # rank (uint32), bits (64 bytes)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left, level = [], [], keys, 0
        while len(left):
            size = max(1, GAMMA * len(left))
            at = (_level_hash(left, level) % U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
            level += 1
        packed = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool))
        blocks = np.zeros(-(-len(packed) // 64), BLOCK)
        blocks["bits"] = np.pad(packed, (0, 64 * len(blocks) - len(packed))).reshape(-1, 64)
        ones = np.bitwise_count(blocks["bits"]).sum(1)
        blocks["rank"] = np.cumsum(ones) - ones
        return cls(np.array(sizes, np.int64), blocks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 where a key is in no level."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level in range(len(self.sizes)):
            if not len(left):
                break
            at = self.bit(keys[left], level)
            hit = np.zeros(len(left), bool)
            for a in range(0, len(left), 1 << 16):
                i = left[a : a + (1 << 16)]
                hit[a : a + len(i)], out[i] = rank(self.blocks[at[a : a + len(i)] >> 9], at[a : a + len(i)] & 511)
            out[left[~hit]] = -1
            left = left[~hit]
        return out

    def bit(self, keys: np.ndarray, level: int) -> np.ndarray:
        return self.begin[level] + (_level_hash(keys, level) % U(self.sizes[level])).astype(np.int64)


def rank(blocks: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a bit of each block: whether it is set, and how many bits are set before it."""
    bits = np.unpackbits(blocks["bits"], axis=1)
    before = (bits & (np.arange(512) < bit[:, None])).sum(1) + blocks["rank"]
    return bits[np.arange(len(bit)), bit] == 1, before


def shard_bytes(keys: np.ndarray, counts: np.ndarray, payload: bytes, width: int, end_id: int) -> bytes:
    """One shard. Where a key repeats, the index points to its first document; the payload holds them all."""
    starts = np.concatenate(([0], np.cumsum(counts))).astype(np.uint64)
    own, first = np.unique(keys, return_index=True)
    mph = PerfectHash.build(own)
    slot = mph.slots(own)
    entries = np.zeros(len(own), ENTRY)
    entries["mark"][slot], entries["place"][slot] = _fingerprint(own), first
    head = np.array([2, width, len(keys), starts[-1], len(own), len(mph.sizes), len(mph.blocks), end_id], np.uint64)
    return b"".join([MAGIC, head.tobytes(), payload, starts.tobytes(), keys.astype(np.int64).tobytes(), mph.sizes.astype(np.uint64).tobytes(), mph.blocks.tobytes(), entries.tobytes()])


class Shard:
    """Keyed access to one shard: an open file, or bytes. Only what a call needs is read."""

    def __init__(self, file):
        self.file = pa.BufferReader(file) if isinstance(file, bytes) else file
        head = self._at(0, 72)
        if head[:8] != MAGIC:
            raise ValueError("not a token shard")
        _, self.width, self.n, ids, slots, levels, blocks, self.end_id = np.frombuffer(head, np.uint64, 8, 8).astype(np.int64).tolist()
        self.kind = np.uint16 if self.width == 2 else np.uint32
        self.starts_at = 72 + ids * self.width
        self.keys_at = self.starts_at + 8 * (self.n + 1)
        sizes_at = self.keys_at + 8 * self.n
        self.blocks_at = sizes_at + 8 * levels
        self.entries_at = self.blocks_at + BLOCK.itemsize * blocks
        self.slots, self.blocks = slots, blocks
        self.hash = PerfectHash(np.frombuffer(self._at(sizes_at, 8 * levels), np.uint64), np.zeros(0, BLOCK))

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _array(self, offset: int, count: int, kind) -> np.ndarray:
        return np.frombuffer(self._at(offset, count * np.dtype(kind).itemsize), kind)

    def find_all(self, keys: np.ndarray) -> np.ndarray:
        """The document of every key, -1 where the shard has none; reads the whole index, but no ids."""
        slot = PerfectHash(self.hash.sizes, self._array(self.blocks_at, self.blocks, BLOCK)).slots(keys)
        entries = self._array(self.entries_at, self.slots, ENTRY)
        ok = slot >= 0
        ok[ok] = entries["mark"][slot[ok]] == _fingerprint(keys[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = entries["place"][slot[ok]]
        return out

    def find(self, key: int) -> int:
        """The document of one key, -1 where the shard has none: a block for each level tried and one slot are read."""
        k = np.array([key], np.int64)
        for level in range(len(self.hash.sizes)):
            at = int(self.hash.bit(k, level)[0])
            hit, slot = rank(self._array(self.blocks_at + BLOCK.itemsize * (at >> 9), 1, BLOCK), np.array([at & 511]))
            if hit[0]:
                entry = self._array(self.entries_at + ENTRY.itemsize * int(slot[0]), 1, ENTRY)
                return int(entry["place"][0]) if entry["mark"][0] == _fingerprint(k)[0] else -1
        return -1

    def document(self, i: int) -> np.ndarray:
        a, b = self._array(self.starts_at + 8 * i, 2, np.uint64).astype(np.int64).tolist()
        return self._array(72 + a * self.width, b - a, self.kind)

    def documents(self):
        """(key, start, ids) of every document, led to by the index from its key; ids are read in slices."""
        keys, starts = self._array(self.keys_at, self.n, np.int64), self._array(self.starts_at, self.n + 1, np.uint64).astype(np.int64)
        own, counts = np.unique(keys, return_counts=True)
        first = self.find_all(own)
        if (first < 0).any():
            raise ValueError("a key is not in the index of its shard")
        place = np.repeat(first, counts) + np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
        key, a, b = np.repeat(own, counts).tolist(), starts[place].tolist(), starts[place + 1].tolist()
        base, held = 0, np.zeros(0, self.kind)
        for k, x, y in zip(key, a, b, strict=True):
            if x < base or y > base + len(held):
                base, held = x, self._array(72 + x * self.width, min(max(y - x, SLICE), int(starts[-1]) - x), self.kind)
            yield k, x, held[x - base : y - base]


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, width: int, bounds: np.ndarray) -> DataFrame:
    """(shard, key, n, ids) of every row: ids as the tokenizers library gives them, then the end id, packed; shard by the bounds of keys."""
    kind = np.uint16 if width == 2 else np.uint32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held((path, f"library {width}"), lambda: PackedTable(path, "H" if width == 2 else "I"))
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                b = batch.slice(a, 500)
                given = b.column(0).cast(pa.int64())
                key = np.where(given.is_null().to_numpy(zero_copy_only=False), NULL_KEY, given.fill_null(0).to_numpy())
                raw, at = text_bytes(b.column(1))
                data = raw.tobytes()
                out = [ids + end for ids in table.joined([data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])]
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, key, "left"), pa.int32()), pa.array(key), pa.array([len(x) // width for x in out], pa.int64()), pa.array(out, pa.binary())], names=["shard", "key", "n", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, "shard int, key long, n long, ids binary")


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Write docs as shards below `folder`; returns the manifest (shard, file, least_key, n_docs, n_ids, start).

    Shards are ranges of keys, cut at quantiles of the keys alone, so texts are encoded once. Any order of
    rows with one key is by their ids. A null key sorts first. An empty text, or null, has the end id alone.
    A file is written under a name of its own attempt and then renamed, so a lost or repeated task leaves
    whole files only. `start` is the number of ids of all shards before.
    """
    spark = docs.sparkSession
    path = vocabulary_path(path)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    n = shards or 4 * shuffle_partitions(spark)
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    def write(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        keys, ids = t.column("key").to_numpy(), t.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (keys[i], ids[i]))
        counts = t.column("n").to_numpy()[order]
        data = shard_bytes(keys[order], counts, b"".join([ids[i] for i in order]), width, end_id)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, draft = f"shard-{shard:08d}.ids", f"_draft-{shard:08d}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{base}/{draft}") as f:
            f.write(data)
        store.move(f"{base}/{draft}", f"{base}/{name}")
        return pa.table({"shard": pa.array([shard], pa.int32()), "file": [name], "least_key": pa.array([int(keys.min())], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([int(counts.sum())], pa.int64())})

    rows = encoded(docs, id_col, text_col, path, end_id, width, bounds)
    done = cut(rows.groupBy("shard").applyInArrow(write, "shard int, file string, least_key long, n_docs long, n_ids long"))
    # one row for each shard: their number is a parameter
    before, starts = 0, []
    for r in done.orderBy("shard").select("shard", "n_ids").collect():
        starts.append((r.shard, before))
        before += r.n_ids
    return done.join(F.broadcast(spark.createDataFrame(starts, "shard int, start long")), "shard")


def shard_documents(folder: str, manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document of the shards, each reached through the index of its shard."""
    n = shuffle_partitions(manifest.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, base = fs.FileSystem.from_uri(folder)
                with store.open_input_file(f"{base}/{name}") as f:
                    rows = [(k, start + a, len(ids), zlib.crc32(ids.astype("<u4"))) for k, a, ids in Shard(f).documents()]
                key, at, size, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key, mask=key == NULL_KEY), pa.array(at), pa.array(size), pa.array(crc)], names=["key", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "start").repartition(n, "file").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, manifest: DataFrame, keys: DataFrame, key_col: str) -> DataFrame:
    """(key, ids) of the given keys that are in the shards: of a key that repeats there, the first document.

    Keys are dealt by range, so that many keys of one shard go to many tasks; each is found by a few seeks. A null
    key finds nothing; a key asked for twice is answered twice.
    """
    rows = manifest.orderBy("shard").select("least_key", "file").collect()  # one for each shard
    bounds, files_of = np.array([r.least_key for r in rows], np.int64), [r.file for r in rows]
    n = shuffle_partitions(manifest.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, shard = None, None, None
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            found, ids = [], []
            key = b.column(0).to_numpy()
            for k, i in zip(key.tolist(), (np.searchsorted(bounds, key, "right") - 1).tolist(), strict=True):
                if i < 0:
                    continue
                if files_of[i] != name:
                    if f is not None:
                        f.close()
                    name = files_of[i]
                    f = store.open_input_file(f"{base}/{name}")
                    shard = Shard(f)
                place = shard.find(k)
                if place >= 0:
                    found.append(k)
                    ids.append(shard.document(place).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["key", "ids"])
        if f is not None:
            f.close()

    asked = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null")
    return asked.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, "key long, ids array<long>")


def op3_query(spark, sf_dir: str) -> DataFrame:
    checkpoint_ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{spark.sparkContext.getCheckpointDir()}/token-shards-{uuid.uuid4().hex}"
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    manifest = write_shards(docs, folder)
    return shard_documents(folder, manifest).withColumnRenamed("key", "doc_id")

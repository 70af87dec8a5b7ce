"""Token ids in sorted-string-table shards, and reading and looking them up again.

File format (all integers little-endian unless said otherwise):

- header: 8 bytes ``JSSTAB01``
- blocks, one after the other: a zstandard frame of entries, then the frame's CRC-32 (4 bytes). Entry:
  varint length of the key prefix shared with the entry before it in the block, varint length of the rest,
  varint number of ids, the rest of the key, the ids as unsigned 32-bit.
- index: one entry a block: first key (9 bytes), offset, frame length, documents, ids (4 unsigned 64-bit)
- Bloom filter over keys: bits, probed at h1 + i*h2 of a 128-bit BLAKE2b hash
- footer, 80 bytes: offsets and lengths of index and filter, documents, ids, blocks, probes (unsigned 64-bit),
  CRC-32 of index and filter (8 bytes), ``JSSTAB01``

A key is one byte (0: null, 1: not) and the big-endian id plus 2**63, so byte order is id order, nulls first.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import encoder

MAGIC = b"JSSTAB01"
BLOCK_BYTES, SHARD_BYTES, BITS_A_KEY, PROBES = 128 << 10, 64 << 20, 10, 7
_INDEX, _FOOTER = struct.Struct("<9s4Q"), struct.Struct("<8QQ8s")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + (int(doc_id) + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes ascending keys to one file object."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=1)
        sink.write(MAGIC)
        self.at, self.index, self.keys = len(MAGIC), [], set()
        self.docs = self.ids = 0
        self._open()

    def _open(self):
        self.block, self.size, self.first, self.last, self.n, self.n_ids = [], 0, None, b"", 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        rest = key[shared:]
        self.block += [_varint(shared), _varint(len(rest)), _varint(len(ids) // 4), rest, ids]
        self.size += len(rest) + len(ids) + 4
        self.last, self.n, self.n_ids = key, self.n + 1, self.n_ids + len(ids) // 4
        self.keys.add(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.n:
            return
        frame = self.zip.compress(b"".join(self.block))
        self.sink.write(frame)
        self.sink.write(struct.pack("<I", zlib.crc32(frame)))
        self.index.append(_INDEX.pack(self.first, self.at, len(frame), self.n, self.n_ids))
        self.at += len(frame) + 4
        self.docs, self.ids = self.docs + self.n, self.ids + self.n_ids
        self._open()

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-len(self.keys) * BITS_A_KEY // 8) * 8)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.sink.write(index)
        self.sink.write(bloom)
        self.sink.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, len(self.index), PROBES, zlib.crc32(index + bloom), MAGIC))


class ShardReader:
    """Reads a shard by its footer: all entries in order, or one key by filter, index search and block."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(size - _FOOTER.size)
        *f, crc, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(f[0])
        raw = source.read(f[1] + f[3])
        if zlib.crc32(raw) != crc:
            raise ValueError("index or filter is damaged")
        self.bloom = raw[f[1] :]
        self.index = [_INDEX.unpack_from(raw, i) for i in range(0, f[1], _INDEX.size)]
        self.first = [x[0] for x in self.index]
        self.docs, self.ids = f[4], f[5]

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, length, n, _ = self.index[i]
        self.source.seek(at)
        raw = self.source.read(length + 4)
        if zlib.crc32(raw[:length]) != struct.unpack("<I", raw[length:])[0]:
            raise ValueError("a block is damaged")
        buf, p, key = self.unzip.decompress(raw[:length]), 0, b""
        for _ in range(n):
            shared, p = _read_varint(buf, p)
            rest, p = _read_varint(buf, p)
            ids, p = _read_varint(buf, p)
            key = key[:shared] + buf[p : p + rest]
            p += rest
            yield key, buf[p : p + 4 * ids]
            p += 4 * ids

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every document with this key; [] if there is none."""
        bits = len(self.bloom) * 8
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits)):
            return []
        out: list[bytes] = []
        i = max(0, bisect_right(self.first, key) - 1)
        while i > 0 and self.first[i] == key:  # equal keys may begin in the block before
            i -= 1
        while i < len(self.index) and self.first[i] <= key:
            out += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return out


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Encode docs(doc_id, text) and write them as shards in ascending doc_id order to the shared folder.

    Null text counts as empty (it has the end id only); a null doc_id sorts first; rows with the same doc_id
    stay as many documents, in order of their text; an empty table gives no shard. Columns besides doc_id and text aren't read.
    Returns the manifest (path, size, first_key, docs, ids), one row a shard. Files of lost or repeated task
    attempts have names of their own and aren't in it.
    """
    scratch = Scratch(spark, "sstable")
    folder = scratch.folder("shards")
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    end = struct.pack("<I", end_id)

    def write(batches):
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        enc = encoder(tokenizer)
        out = sink = path = first = None

        def close():
            out.close()
            size = sink.tell()
            sink.close()
            row = {"path": [path], "size": [size], "first_key": [first], "docs": [out.docs], "ids": [out.ids]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("first_key", pa.binary()), ("docs", pa.int64()), ("ids", pa.int64())]))

        import pyarrow as pa

        for batch in batches:
            keys = [key_of(x) for x in batch.column("doc_id").to_pylist()]
            for at in range(0, len(keys), 2000):
                for key, ids in zip(keys[at : at + 2000], enc.encode(batch.column("text").slice(at, 2000)), strict=True):
                    if out is not None and out.at + out.size >= SHARD_BYTES:
                        yield close()
                        out = None
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.sst"
                        sink = files.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}")
                        out, first = ShardWriter(sink), key
                    out.add(key, ids + end)
        if out is not None:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.save(rows.mapInArrow(write, "path string, size long, first_key binary, docs long, ids long"), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids (binary).

    The driver holds one short row a shard (at least SHARD_BYTES each but for the last of a partition).
    """
    rows, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (bytes(r.first_key), r.path)):
        rows.append((r.path, r.size, start))
        start += r.ids
    listed = spark.createDataFrame(rows, "path string, size long, start long").repartition(max(1, len(rows)), "path")

    def load(batches):
        import pyarrow as pa

        for batch in batches:
            for path, size, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                files, name = _filesystem(path)
                with files.open_input_file(name) as f:
                    shard, part = ShardReader(f, size), []
                    for i in range(len(shard.index)):
                        for key, ids in shard.block(i):
                            part.append((id_of(key), at, len(ids) // 4, ids))
                            at += len(ids) // 4
                        if len(part) >= 1000 or i == len(shard.index) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])
                            part = []

    return listed.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest_rows: list, doc_id: int | None) -> list[bytes]:
    """Ids of the documents with this id, by binary search over shards, filter, block index and block."""
    rows = sorted(manifest_rows, key=lambda r: (bytes(r.first_key), r.path))
    key, out = key_of(doc_id), []
    i = max(0, bisect_right([bytes(r.first_key) for r in rows], key) - 1)
    while i > 0 and bytes(rows[i].first_key) == key:
        i -= 1
    for r in rows[i:]:
        if bytes(r.first_key) > key:
            break
        files, name = _filesystem(r.path)
        with files.open_input_file(name) as f:
            out += ShardReader(f, r.size).get(key)
    return out

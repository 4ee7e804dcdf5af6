"""Token ids as sorted-string-table shards, and their readers.

A shard file holds documents in key order:

    data blocks | index block | Bloom filter | footer

A data block (about BLOCK_BYTES before compression, zstd) holds entries; an entry is the number of
leading key bytes it shares with the entry before it, the number of further key bytes, the number of ids
(three unsigned 32-bit integers), those key bytes and the ids, little-endian and `width` bytes each. Every
RESTART-th entry shares nothing. The index holds for each block its last key, offset and length; the
filter has ten bits an id and seven probes; the footer has a fixed size.

A key is the document id as eight big-endian bytes with the sign bit turned, so byte order is number
order, then the number of the task that wrote it and the row's number among the task's equal ids (four bytes each): one id may
span tasks, and every row has a key of its own. A null id is an empty key and comes first; rows without id share it.

Shards are written by the tasks of one range partitioning, each under a name of its own; the
manifest, written through Spark's commit protocol, names the files of the attempts that count, so a
lost executor or a repeated task leaves only files nobody reads.

Defined results: null and empty texts have only the end id. Repeated rows and ids are all kept; equal
ids stand in an order by text. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, materialize
from .token_counts import JsonCodec, PieceCodec, Units, codec
from .words import slices, tidy

BLOCK_BYTES = 1 << 16
RESTART = 16
BITS, PROBES = 10, 7
#: A task starts a further shard beyond so many bytes.
SHARD_BYTES = 256 << 20
MAGIC = b"RMSST001"
_FOOTER = struct.Struct("<QQQQQQIIQ8s")  # index at, size; filter at, size; documents, ids; width, blocks; filter bits; magic
_ENTRY = struct.Struct("<III")
_INDEX = struct.Struct("<HQI")
END_ID = 0


def key_of(doc_id: int | None, ordinal: int = 0, task: int = 0) -> bytes:
    return b"" if doc_id is None else struct.pack(">QII", doc_id + (1 << 63), task, ordinal)


def id_of(key: bytes) -> int | None:
    return None if len(key) < 8 else struct.unpack(">Q", key[:8])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> Iterator[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return ((a + i * b) % 2**64 % bits for i in range(PROBES))


class ShardWriter:
    """Entries must come in key order."""

    def __init__(self, sink, width: int):
        import zstandard

        self.sink, self.width, self.at = sink, width, 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self.block, self.size, self.n, self.last = [], 0, 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []
        self.docs = self.ids = 0

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.n % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += (_ENTRY.pack(shared, len(key) - shared, len(ids) // self.width), key[shared:], ids)
        self.size += 12 + len(key) - shared + len(ids)
        self.n, self.last = self.n + 1, key
        if not self.hashes or self.hashes[-1] != key[:8]:
            self.hashes.append(key[:8])
        self.docs, self.ids = self.docs + 1, self.ids + len(ids) // self.width
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.n:
            data = self.zip.compress(b"".join(self.block))
            self.sink.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
        self.block, self.size, self.n = [], 0, 0

    def close(self) -> None:
        self.flush()
        index = b"".join(_INDEX.pack(len(k), at, n) + k for k, at, n in self.index)
        bits = max(64, BITS * len(self.hashes))
        field = np.zeros((bits + 7) // 8, np.uint8)
        for k in self.hashes:
            for p in _probes(k, bits):
                field[p >> 3] |= 1 << (p & 7)
        self.sink.write(index)
        self.sink.write(field.tobytes())
        self.sink.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(field), self.docs, self.ids, self.width, len(self.index), bits, MAGIC))
        self.sink.close()


def _entries(data: bytes, width: int) -> Iterator[tuple[bytes, bytes]]:
    at, key = 0, b""
    while at < len(data):
        shared, more, n = _ENTRY.unpack_from(data, at)
        at += 12
        key = key[:shared] + data[at : at + more]
        at += more
        yield key, data[at : at + n * width]
        at += n * width


class ShardReader:
    """Scans a shard, or looks a key up: filter, binary search in the index, one block."""

    def __init__(self, path: str):
        import zstandard

        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        self.unzip = zstandard.ZstdDecompressor()
        self.file.seek(self.file.size() - _FOOTER.size)
        self.index_at, self.index_size, self.filter_at, self.filter_size, self.docs, self.ids, self.width, self.blocks, self.bits, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.file.seek(self.index_at)
        raw, at, self.index = self.file.read(self.index_size), 0, []
        while at < len(raw):
            n, offset, size = _INDEX.unpack_from(raw, at)
            at += _INDEX.size
            self.index.append((raw[at : at + n], offset, size))
            at += n
        self.field: bytes | None = None

    def _block(self, k: int) -> bytes:
        _, at, n = self.index[k]
        self.file.seek(at)
        return self.unzip.decompress(self.file.read(n))

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from _entries(self._block(k), self.width)

    def may_hold(self, prefix: bytes) -> bool:
        """The filter's word on an id (the first eight bytes of a key)."""
        if self.field is None:
            self.file.seek(self.filter_at)
            self.field = self.file.read(self.filter_size)
        return all(self.field[p >> 3] >> (p & 7) & 1 for p in _probes(prefix, self.bits))

    def find(self, prefix: bytes) -> Iterator[tuple[bytes, np.ndarray]]:
        """Keys that begin with the prefix, and their ids: filter, binary search in the index, then as few blocks as hold them."""
        if not self.may_hold(prefix[:8]):
            return
        for k in range(bisect.bisect_left(self.index, prefix, key=lambda x: x[0]), len(self.index)):
            for key, ids in _entries(self._block(k), self.width):
                if key.startswith(prefix):
                    yield key, unpacked(ids, self.width)
                elif key > prefix:
                    return

    def __getitem__(self, key: bytes) -> np.ndarray:
        """The ids under the key; KeyError if there are none."""
        for found, ids in self.find(key):
            if found == key:
                return ids
        raise KeyError(key)


def unpacked(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4")


class Encoder:
    """Packed ids of whole texts."""

    def __init__(self, path: str):
        self.codec = c = codec(path)
        size = c.tokenizer.get_vocab_size() if isinstance(c, JsonCodec) else len(c.sp)
        self.width = 2 if size <= 1 << 16 else 4
        kind = "H" if self.width == 2 else "I"
        swap = sys.byteorder == "big"

        def pack(ids: list[int]) -> bytes:
            a = array(kind, ids)
            if swap:
                a.byteswap()
            return a.tobytes()

        self.pack = pack
        self.units = Units(c, self.pack)
        self.end = self.pack([END_ID])

    def __call__(self, texts: list[str]) -> list[bytes]:
        c = self.codec
        if not c.cuttable or isinstance(c, PieceCodec):
            return [self.pack(x) + self.end for x in c.ids(texts)]
        return [b"".join(self.units(x)) + self.end for x in texts]


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


MANIFEST = "shard string, first_id long, last_id long, n_docs long, n_ids long, n_bytes long, part int, nth int"


def write_shards(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every text, writes the shards under out and returns the manifest. out is a URI that all executors see."""
    from pyspark import TaskContext

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out)
        fs.create_dir(base, recursive=True)
        width, task, nth, w, rows = encoder(path).width, TaskContext.get().partitionId(), 0, None, []
        last, ordinal, first, name = object(), 0, None, ""

        def done():
            w.close()
            rows.append((f"{out}/{name}", first, last, w.docs, w.ids, w.at, task, nth))

        encode = encoder(path)
        parts = (part for batch in batches for part in slices(batch))
        for part_ids, part_texts in ((p.column("doc_id").to_pylist(), p.column("text").to_pylist()) for p in parts):
            for doc_id, ids in zip(part_ids, encode([x or "" for x in part_texts]), strict=True):
                if w is not None and w.at >= shard_bytes:
                    done()
                    w, nth = None, nth + 1
                ordinal = ordinal + 1 if doc_id == last else 0
                if w is None:
                    name, first = f"{task:08d}-{nth:05d}-{uuid.uuid4().hex}.sst", doc_id
                    w = ShardWriter(fs.open_output_stream(f"{base}/{name}"), width)
                w.add(key_of(doc_id, ordinal, task), ids)
                last = doc_id
        if w is not None:
            done()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(n, pa.string() if n == "shard" else pa.int32() if n in ("part", "nth") else pa.int64()) for n in names]))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # equal ids are dealt and sorted by their content, so that a hot id is no hot task; texts are encoded after that, once
    ranged = d.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return materialize(ranged.mapInArrow(tidy(written), MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, ids (array), start (ids of all documents before it) and the crc32 of the ids, from the files."""
    spark = manifest.sparkSession
    starts, n = {}, 0
    # one short row for each shard of SHARD_BYTES or each task
    for r in manifest.select("shard", "n_ids", "part", "nth").orderBy("part", "nth").toLocalIterator():
        starts[r.shard] = n
        n += r.n_ids
    files = list(starts)
    listed = spark.createDataFrame([(f, starts[f]) for f in files], "shard string, base long").repartition(max(1, len(files)), "shard") if files else spark.createDataFrame([], "shard string, base long")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, at, rows = ShardReader(shard), base, []
                for key, ids in reader.scan():
                    own = unpacked(ids, reader.width)
                    rows.append((id_of(key), at, len(own), zlib.crc32(own.astype("<u4").tobytes())))
                    at += len(own)
                    if len(rows) == 10_000:
                        yield _digests(rows)
                        rows = []
                yield _digests(rows)

    return listed.mapInArrow(tidy(scanned), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of every row with this id, by binary search: shards by their first and last id, then filter, index and block."""
    holds = (F.coalesce("first_id", F.lit(-(2**63))) <= doc_id) & (F.col("last_id") >= doc_id)
    shards = manifest.filter(holds).orderBy("part", "nth").select("shard").collect()
    return [ids for r in shards for _, ids in ShardReader(r.shard).find(key_of(doc_id)[:8])]


def token_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the shards to the shared folder; the manifest and what the files hold."""
    manifest = write_shards(docs, path, _as_uri(docs.sparkSession, fresh_dir(docs.sparkSession, "sst")), id_col, text_col)
    return manifest, read_shards(manifest)


def _as_uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme: that of the default file system where it has none, as for Spark's tables."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


__all__ = ["Encoder", "ShardReader", "ShardWriter", "lookup", "read_shards", "token_shards", "write_shards"]

"""Token ids in one compressed file per shard, as a wavelet matrix.

A shard holds the ids of consecutive documents. Bit k of all ids (the highest first) forms plane k;
after each plane the ids are stably parted by that bit. Each plane keeps the number of ones before
every 512 bits, so that rank takes a short popcount and select a binary search; `access`, `rank`,
`select` and `count` work on the compressed file and inflate only the plane blocks that they touch.

File format, little-endian: magic `WVM1`; u32 planes, documents, block bytes, blocks per plane;
u64 ids; per plane u64 zeros; per plane and block u32 compressed length; u32 length and zstd frame
of the documents' id counts (u32 each); then the planes' blocks, each a zstd frame."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm import encode
from alleleflow.llm.shared import in_slices, table, text_or_empty

_MAGIC = b"WVM1"
_BLOCK = 1 << 15      # bytes of a plane in one zstd frame
_STEP = 64            # bytes between two entries of a plane's rank directory


def _planes(ids: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """Packed bits and number of zeros of each plane."""
    for k in range(bits - 1, -1, -1):
        one = ((ids >> ids.dtype.type(k)) & ids.dtype.type(1)).astype(bool)
        yield np.packbits(one, bitorder="little"), int(len(ids) - np.count_nonzero(one))
        ids = np.concatenate([ids[~one], ids[one]])


def build(ids: np.ndarray, counts: list[int] | np.ndarray, bits: int) -> bytes:
    """The file of one shard: `ids` of documents that have `counts` ids each."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    per_plane = -(-max(len(ids), 1) // (8 * _BLOCK))
    zeros, lengths, body = [], [], []
    for plane, zero in _planes(ids, bits):
        zeros.append(zero)
        raw = plane.tobytes()
        for b in range(per_plane):
            frame = pack(raw[b * _BLOCK:(b + 1) * _BLOCK])
            lengths.append(len(frame))
            body.append(frame)
    docs = pack(np.asarray(counts, dtype="<u4").tobytes())
    return b"".join([_MAGIC, struct.pack("<4IQ", bits, len(counts), _BLOCK, per_plane, len(ids)),
                     struct.pack(f"<{bits}Q", *zeros), np.array(lengths, dtype="<u4").tobytes(),
                     struct.pack("<I", len(docs)), docs, *body])


class WaveletShard:
    """Reads one file."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        self._data = data
        self._inflate = zstandard.ZstdDecompressor().decompress
        self.bits, n_docs, self._block, self._per_plane, self.n = struct.unpack_from("<4IQ", data, 4)
        at = 28
        self.zeros = struct.unpack_from(f"<{self.bits}Q", data, at)
        at += 8 * self.bits
        lengths = np.frombuffer(data, "<u4", self.bits * self._per_plane, at).astype(np.int64)
        at += 4 * len(lengths)
        (size,) = struct.unpack_from("<I", data, at)
        self.doc_counts = np.frombuffer(self._inflate(data[at + 4:at + 4 + size]) if n_docs else b"", "<u4")
        self._starts = at + 4 + size + np.concatenate([[0], np.cumsum(lengths)])
        self._frames: dict[int, np.ndarray] = {}
        self._sums: dict[int, np.ndarray] = {}

    def _frame(self, plane: int, block: int) -> np.ndarray:
        k = plane * self._per_plane + block
        if k not in self._frames:
            self._frames[k] = np.frombuffer(self._inflate(self._data[self._starts[k]:self._starts[k + 1]]), np.uint8)
        return self._frames[k]

    def _plane(self, plane: int) -> np.ndarray:
        return np.concatenate([self._frame(plane, b) for b in range(self._per_plane)])

    def _directory(self, plane: int) -> np.ndarray:
        """Ones before each step of the plane."""
        if plane not in self._sums:
            ones = np.bitwise_count(self._plane(plane)).astype(np.int64)
            self._sums[plane] = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), _STEP)) if len(ones) else ones)])
        return self._sums[plane]

    def _bit(self, plane: int, i: int) -> int:
        return int(self._frame(plane, i // 8 // self._block)[i // 8 % self._block] >> (i % 8)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        step, byte = i // 8 // _STEP, i // 8
        n = int(self._directory(plane)[step])
        for at in range(step * _STEP, byte):
            n += int(self._frame(plane, at // self._block)[at % self._block]).bit_count()
        if i % 8:
            n += (int(self._frame(plane, byte // self._block)[byte % self._block]) & ((1 << i % 8) - 1)).bit_count()
        return n

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for p in range(self.bits):
            bit, ones = self._bit(p, i), self._ones(p, i)
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def _interval(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of `value` among positions lo to hi end up below the last plane."""
        for p in range(self.bits):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if value >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of `value` in positions lo to hi, hi excluded."""
        if value >> self.bits:
            return 0
        a, b = self._interval(value, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, value: int, i: int) -> int:
        return self.count(value, 0, i)

    def select(self, value: int, k: int) -> int:
        """Position of occurrence k (from 0) of `value`, or -1."""
        if value >> self.bits:
            return -1
        lo, hi = self._interval(value, 0, self.n)
        i = lo + k
        if not 0 <= k < hi - lo:
            return -1
        for p in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - p) & 1
            want = i - self.zeros[p] if bit else i
            a, b = 0, self.n                      # the last a with `want` such bits before it
            while b - a > 1:
                mid = (a + b) // 2
                ones = self._ones(p, mid)
                if (ones if bit else mid - ones) <= want:
                    a = mid
                else:
                    b = mid
            i = a
        return i

    def positions(self, value: int, limit: int | None = None) -> list[int]:
        n = self.count(value)
        return [self.select(value, k) for k in range(n if limit is None else min(n, limit))]

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, dtype=kind)
        for p in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self._plane(p), count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(values)
            up[~one] = values[:self.zeros[p]]
            up[one] = values[self.zeros[p]:] | kind(1 << (self.bits - 1 - p))
            values = up
        return values


_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("file", pa.binary())])
SHARD_SCHEMA = "part int, shard long, start long, n_ids long, doc_ids array<long>, file binary"


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 1, partitions: int | None = None,
                 shard_ids: int = 1 << 21, tokenizer: str | None = None) -> DataFrame:
    """Encode whole `text`s, append `end_id` to each, and write them in ascending doc_id order as
    wavelet-matrix shards, one file each of about `shard_ids` ids (a document is never cut).

    Returns the written table: part, shard (number in the part), start (ids before it in the
    part), n_ids, doc_ids, file. Parts follow each other in doc_id order; nulls come first; equal
    doc_ids are ordered by their text's hash. A null text has the end id only. Extra columns are
    ignored; an empty table gives an empty one."""
    spark = docs.sparkSession
    tokenizer = tokenizer or encode.default_path()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select("doc_id", text_or_empty(), F.xxhash64("text").alias("h"))
               .repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
               .select("doc_id", "text", F.spark_partition_id().alias("part")))

    def shards(batches):
        enc = encode.encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype)
        bits = max(int(len(enc.word_end) - 1).bit_length(), end_id.bit_length())
        pending, names, counts = [], [], []
        state = {"part": 0, "shard": 0, "start": 0, "held": 0}

        def flush():
            ids = np.concatenate(pending) if pending else np.zeros(0, enc.dtype)
            row = pa.RecordBatch.from_arrays(
                [pa.array([x], t.type) for x, t in zip(
                    (state["part"], state["shard"], state["start"], len(ids), names, build(ids, counts, bits)), _SHARD)],
                schema=_SHARD)
            state["shard"] += 1
            state["start"] += len(ids)
            state["held"] = 0
            pending.clear(), names.clear(), counts.clear()
            return row

        def each(batch):
            state["part"] = batch.column("part")[0].as_py()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                pending.extend([ids, end])
                names.append(doc_id)
                counts.append(len(ids) + 1)
                state["held"] += len(ids) + 1
                if state["held"] >= shard_ids:
                    yield flush()

        yield from in_slices(each)(batches)
        if names:
            yield flush()

    out = ordered.mapInArrow(shards, SHARD_SCHEMA)
    options = {"maxRecordsPerFile": 1, "compression": "none"}
    if path is None:
        return table(out, "wavelet", **options)
    out.write.options(**options).parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Read shards back: per document doc_id, start (ids of all documents before it), n_tokens and
    ids (int array), from the files alone. The driver holds one number per part."""
    spark = shards.sparkSession
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base, total = {}, 0
    for r in sizes:
        base[r["part"]] = total
        total += r["n"]
    given = spark.sparkContext.broadcast(base)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = WaveletShard(row["file"])
                ids = shard.ids()
                ends = np.cumsum(shard.doc_counts.astype(np.int64))
                starts = ends - shard.doc_counts
                first = given.value[row["part"]] + row["start"]
                for k in range(0, len(ends), 256):
                    part = slice(k, min(k + 256, len(ends)))
                    flat = ids[starts[k]:ends[part.stop - 1]].astype(np.int32)
                    cuts = np.append(starts[part], ends[part.stop - 1]) - starts[k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][part], pa.int64()), pa.array(first + starts[part], pa.int64()),
                         pa.array(shard.doc_counts[part].astype(np.int64)),
                         pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return shards.select("part", "start", "doc_ids", "file").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids array<int>")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as unsigned 32-bit integers."""
    import zlib

    def crc(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat, cuts = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")

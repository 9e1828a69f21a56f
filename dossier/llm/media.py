"""Media columns: payloads live once per shard in tar files, addressed by digest; rows carry digest, offset and length.

Three steps, each restartable by itself:

* ``write_shards`` turns every payload into a greyscale PNG (64 samples a row, 8 bits each), appends it to the tar shard of
  its task and returns the index. A shard's name holds a random part, so a task that runs again after a lost executor
  writes new shards and its index rows point at those; shards of failed attempts are never referenced.
* ``read_headers`` reads the first 33 bytes of a member and fills the metadata columns without touching the samples.
* ``read_features`` reads members whole and returns digests and features of the samples.

Nulls and empty texts become one block of 64 zero bytes. Equal payloads of a shard are stored once. A null id is kept.
Only the named id and text columns are read, so further columns with any names do no harm. A text of any length is one payload, held whole by
its task. Repeated rows come back one for one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, parallelism, slices

WIDTH = 64
HEADER_BYTES = 33
SHARD_BYTES = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"

INDEX_SCHEMA = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
HEADER_SCHEMA = INDEX_SCHEMA + ", width int, height int, bit_depth int, colour_type int"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, width int, height int"


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the row width."""
    return raw + b"\0" * (WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """Lossless 8-bit greyscale image of the payload."""
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    # Each row begins with its filter's number: 0, samples as they are.
    rows, height = zlib.compress(np.pad(samples, ((0, 0), (1, 0))).tobytes(), 6), len(samples)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", rows) + _chunk(b"IEND", b"")


def parse_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first bytes of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(media: bytes) -> bytes:
    """Samples of an image that encode_png wrote."""
    width, height, depth, colour = parse_header(media[:HEADER_BYTES])
    if (depth, colour) != (8, 0):
        raise ValueError("only 8-bit greyscale is stored")
    at, rows = 8, []
    while at < len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        if media[at + 4 : at + 8] == b"IDAT":
            rows.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    flat = np.frombuffer(zlib.decompress(b"".join(rows)), dtype=np.uint8).reshape(height, width + 1)
    return flat[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size, mean sample, number of distinct samples and a 16-bin histogram digest; a function of the samples alone."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    bins = np.bincount(samples >> 4, minlength=16)
    mean = int(samples.sum(dtype=np.int64)) * 1000 // len(samples)
    return f"{WIDTH}x{len(samples) // WIDTH}|mean={mean}|distinct={len(np.unique(samples))}|hist={'.'.join(map(str, bins))}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Shard:
    """Tar file being written; add() returns offset and length of a member's bytes."""

    def __init__(self, folder: str, name: str):
        self.store, base = _filesystem(folder)
        self.name, self.at, self.members = name, 0, {}
        self.out = self.store.open_output_stream(f"{base}/{name}")

    def add(self, digest: str, encode) -> tuple[int, int]:
        if digest not in self.members:
            media = encode()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.GNU_FORMAT)
            fill = -len(media) % 512
            self.out.write(head + media + b"\0" * fill)
            self.members[digest] = (self.at + len(head), len(media))
            self.at += len(head) + len(media) + fill
        return self.members[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store each text's payload below folder (any URI that pyarrow opens) and return the index, lazily; save it before use."""

    def run(batches):
        task, shard, n = TaskContext.get(), None, 0
        stem = f"{task.partitionId():06d}-{uuid.uuid4().hex}" if task else uuid.uuid4().hex
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                payload = pad(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if shard is None or shard.at >= shard_bytes:
                    if shard:
                        shard.close()
                    shard, n = _Shard(folder, f"shard-{stem}-{n:04d}.tar"), n + 1
                offset, length = shard.add(digest, lambda p=payload: encode_png(p))
                rows.append((doc_id, len(raw), digest, shard.name, offset, length))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    jvm = docs.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(where)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX_SCHEMA)


class _Reader:
    """Range reads on shards; one file is open at a time as the rows come sorted by shard."""

    def __init__(self, folder: str):
        self.store, self.base = _filesystem(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, n: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = shard, self.store.open_input_file(f"{self.base}/{shard}")
        self.file.seek(offset)
        got = self.file.read(n)
        if len(got) != n:
            raise OSError(f"{shard} ends before {offset + n}")
        return got

    def close(self) -> None:
        if self.file:
            self.file.close()


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """Index with width, height, bit depth and colour type, from range reads of 33 bytes a row."""

    def run(batches):
        reader = _Reader(folder)
        for batch in batches:
            heads = [parse_header(reader.read(r["shard"], r["offset"], HEADER_BYTES)) for r in batch.select(["shard", "offset"]).to_pylist()]
            new = list(zip(*heads)) if heads else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in new)], names=[*batch.schema.names, "width", "height", "bit_depth", "colour_type"])
        reader.close()

    return index.mapInArrow(run, HEADER_SCHEMA)


def read_features(headers: DataFrame, folder: str, keep: int = 1024) -> DataFrame:
    """Digests and features from the stored bytes. The last `keep` members' results are remembered, for copies that follow each other."""

    def run(batches):
        reader, seen = _Reader(folder), OrderedDict()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                at = (r["shard"], r["offset"])
                if at not in seen:
                    media = reader.read(r["shard"], r["offset"], r["length"])
                    payload = decode_png(media)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest != r["digest"]:
                        raise ValueError(f"{at} does not hold {r['digest']}")
                    seen[at] = (len(payload), digest, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))
                    if len(seen) > keep:
                        seen.popitem(last=False)
                rows.append((r["doc_id"], r["n_bytes"], *seen[at], r["shard"], r["offset"], r["width"], r["height"]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height"])
        reader.close()

    return headers.mapInArrow(run, FEATURE_SCHEMA)


def media_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All three steps over docs (doc_id, text). The index is written before anything reads the shards; reading is dealt by place, so that a task reads one stretch of a shard."""
    space = Workspace(spark, "media")
    folder = space.path("shards")
    index = space.save(write_shards(docs, folder), "index")
    dealt = index.repartitionByRange(parallelism(spark), "shard", "offset", "doc_id").sortWithinPartitions("shard", "offset")
    return read_features(read_headers(dealt, folder), folder)

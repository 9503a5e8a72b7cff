"""Content-addressed payloads in tar shards.

A payload is stored as a grey 8-bit PNG of 576 samples a line, without loss,
under the digest of its bytes. Each task streams its payloads into tar shards
in the shared folder, each distinct payload once, and the committed index has
a row a document: digest, shard, offset and length. Files that a failed
attempt left are not in the index. Metadata come from range reads of the first
33 bytes of each stored form; payloads from range reads of the whole.

No text is shuffled and no task waits for another: a digest that occurs in
several tasks is stored by each, and ``catalogue`` names one place for it.

Rows are read back in parts of about ``PART_BYTES`` of stored bytes, those that
lie next to each other together.

Defined results: a null text is empty; a payload is never empty (an empty text
is 576 bytes 255); equal texts, repeated rows too, have equal values, whatever
their ids; a text of any length is one payload, encoded and read in one piece;
an empty table gives an empty index; other columns of the documents are not
read, and columns of an index that bear a name of a result are refused.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm import wordhash as W
from kinfold.llm.common import materialize, parallelism, partitions, shared_dir

LINE = 576
FILL = 255
SHARD_BYTES = 256 << 20
LEVEL = 3
HEADER_BYTES = 33
#: Stored bytes that a task reads back, about.
PART_BYTES = 64 << 20
#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    lines = max(1, -(-len(text) // LINE))
    return text.ljust(lines * LINE, bytes([FILL]))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """The payload as a PNG; every line begins with the filter type 0."""
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(first: bytes) -> dict:
    """Width, height, depth and colour type, from a stored form's first bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    width, height, depth, colour = struct.unpack(">IIBB", first[16:26])
    return {"width": width, "height": height, "depth": depth, "colour": colour}


def decode(stored: bytes) -> bytes:
    head, at, body = header(stored), 8, b""
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        kind, part = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a stored payload is damaged")
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(head["height"], head["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("only lines without a filter are stored")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """A short description of the samples: mean, deviation, entropy in bits, and the distinct values."""
    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(float)
    n = count.sum()
    value = np.arange(256.0)
    mean = float((count * value).sum() / n)
    spread = float(max(0.0, (count * value * value).sum() / n - mean * mean)) ** 0.5
    p = count[count > 0] / n
    return f"mean={mean:.3f};std={spread:.3f};entropy={max(0.0, float(-(p * np.log2(p)).sum())):.3f};distinct={len(p)}"


class _Shards:
    """Tar shards that one task writes."""

    def __init__(self, uri: str):
        self.fs, self.dir = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.dir, recursive=True)
        self.out, self.at, self.path = None, 0, ""

    def add(self, name: str, stored: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.path = f"{self.dir}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
            self.out, self.at = self.fs.open_output_stream(self.path), 0
        info = tarfile.TarInfo(f"{name}.png")
        info.size = len(stored)
        begin = self.at + tarfile.BLOCKSIZE
        pad = -len(stored) % tarfile.BLOCKSIZE
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + stored + bytes(pad))
        self.at = begin + len(stored) + pad
        return self.path, begin, len(stored)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads; the index: doc_id, n_bytes, digest (sha256 of the payload), shard, offset, length."""
    spark = docs.sparkSession
    uri = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = _Shards(uri), {}
        try:
            for batch in batches:
                rows = []
                data, at = W.bytes_of(W.as_strings(batch.column("text")))
                view = memoryview(data)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    payload = payload_of(bytes(view[a:b]))
                    digest = hashlib.sha256(payload).digest()
                    if digest not in known:
                        known[digest] = shards.add(digest.hex(), encode(payload))
                    rows.append((int(b - a), digest.hex(), *known[digest]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = own.mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return materialize(index, "media-index").withColumn("store", F.lit(uri))


def catalogue(index: DataFrame) -> DataFrame:
    """One place for each digest, and how many documents refer to it."""
    return index.groupBy("digest").agg(F.min(F.struct("store", "shard", "offset", "length")).alias("place"), F.count("*").alias("n_refs")).select("digest", "place.*", "n_refs")


class _Reader:
    """Range reads of shards; the last file stays open."""

    def __init__(self):
        self.fs: dict[str, pafs.FileSystem] = {}
        self.path, self.file = "", None

    def read(self, store_uri: str, path: str, offset: int, length: int) -> bytes:
        if store_uri not in self.fs:
            self.fs[store_uri] = pafs.FileSystem.from_uri(store_uri)[0]
        if path != self.path:
            if self.file is not None:
                self.file.close()
            self.path, self.file = path, self.fs[store_uri].open_input_file(path)
        return self.file.read_at(length, offset)


def _each(index: DataFrame, one, fields: list[tuple[str, T.DataType, pa.DataType]], touched) -> DataFrame:
    """``one(bytes)`` of each row's stored form, once for neighbours that share a place. ``touched``: bytes that a row reads."""
    spark, names = index.sparkSession, [n for n, _, _ in fields]
    if clash := sorted({c.lower() for c in index.columns} & set(names)):
        raise ValueError(f"the index has columns called like results: {', '.join(clash)}")
    size = index.agg(F.sum(touched)).first()[0] or 0
    near = F.floor(F.col("offset") / PART_BYTES)
    index = index.repartition(partitions(spark, max(parallelism(spark), 4 * size // PART_BYTES)), "shard", near).sortWithinPartitions("shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, recent = _Reader(), OrderedDict()
        for batch in batches:
            rows = []
            for place in zip(*(batch.column(c).to_pylist() for c in ("store", "shard", "offset", "length")), strict=True):
                if place not in recent:
                    recent[place] = one(reader, *place)
                    if len(recent) > 4096:
                        recent.popitem(last=False)
                rows.append(recent[place])
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.record_batch([*batch.columns, *(pa.array(c, k) for c, (_, _, k) in zip(columns, fields, strict=True))], names=[*batch.schema.names, *names])

    return index.mapInArrow(run, T.StructType([*index.schema.fields, *(T.StructField(n, k) for n, k, _ in fields)]))


def _longs(*names: str) -> list[tuple[str, T.DataType, pa.DataType]]:
    return [(n, T.LongType(), pa.int64()) for n in names]


def metadata(index: DataFrame) -> DataFrame:
    """The index with width, height and depth, from header-only range reads."""

    def one(reader: _Reader, uri: str, path: str, offset: int, length: int) -> tuple:
        h = header(reader.read(uri, path, offset, min(length, HEADER_BYTES)))
        return h["width"], h["height"], h["depth"]

    return _each(index, one, _longs("width", "height", "depth"), F.lit(HEADER_BYTES))


def read_back(index: DataFrame) -> DataFrame:
    """The index with digests and features of the payloads as they are stored."""

    def one(reader: _Reader, uri: str, path: str, offset: int, length: int) -> tuple:
        stored = reader.read(uri, path, offset, length)
        payload = decode(stored)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)

    texts = {n: (n, T.StringType(), pa.string()) for n in ("payload_sha256", "media_sha256", "feature")}
    (size, tail, media) = _longs("payload_bytes", "tail_crc32", "media_bytes")
    return _each(index, one, [size, texts["payload_sha256"], tail, media, texts["media_sha256"], texts["feature"]], F.col("length"))

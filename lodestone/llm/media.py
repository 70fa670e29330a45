"""Media columns: texts stored losslessly as 8-bit greyscale PNG members of archives, read back by byte range.

`media_archive` is a Python data source. Writing: each task appends members to archives of bounded size under names
of its own and reports them; each commit writes a manifest of its own of the reported archives only, so retried or
speculative tasks leave nothing that a reader sees, and appends add up. Reading: the driver plans partitions as byte
ranges of archives from the manifests alone; a task reads the archive's index (bounded by the archive's size), takes the members that begin in its
range and streams them as Arrow batches. Each member is read, checked and, if need be, tried again by its own offset.
Rows with texts are encoded by the task that writes them, and the option `measured` has the task that reads members
return what they say: neither way do media pass through Spark.

Archive: members one after the other; then the index, an Arrow IPC stream; then its length as eight bytes.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lodestone.llm.common import shared_dir, text_chunks

#: Payloads are filled with 255 up to a multiple of FRAME bytes, an image SIDE samples wide.
FRAME, SIDE, FILL = 576, 24, 255
#: Bytes of an archive before another begins, of a read partition, and of a batch sent to Spark; tries of a member.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 64 << 20, 16 << 20, 4 << 20, 3
#: Read partitions, beyond which their ranges grow (one archive each at most).
MOST_RANGES = 100_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
#: Types of ids: whole numbers as they are, all others as texts.
IDS = {"long": pa.int64(), "string": pa.string()}
_INDEX = pa.schema([("n_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("crc32", pa.int64())])
MANIFEST = ".manifest.json"
MEMBER = "n_bytes long, media binary"
MEASURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MEASURED = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (c.split() for c in MEASURES.split(", "))])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def payload_of(text: bytes) -> bytes:
    return text + bytes([FILL]) * (-len(text) % FRAME if text else FRAME)


def to_png(payload: bytes) -> bytes:
    """8-bit greyscale image, SIDE wide, with unfiltered rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    head = SIDE.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image; ValueError for anything else, a broken checksum included."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts, height = 8, [], 0
    while at < len(media):
        n, kind = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != int.from_bytes(media[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("checksum of a chunk")
        if kind == b"IHDR":
            if int.from_bytes(body[:4], "big") != SIDE or body[8:] != bytes([8, 0, 0, 0, 0]):
                raise ValueError("another kind of image")
            height = int.from_bytes(body[4:8], "big")
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, SIDE + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifests(files: fs.FileSystem, root: str) -> list[str]:
    return sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(MANIFEST))


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class ByteRange(InputPartition):
    archive: str
    first: int
    last: int


def _members(columns: dict[str, pa.Array], batch: pa.RecordBatch) -> Iterator[tuple[int | str | None, int, bytes]]:
    """doc_id, n_bytes and stored form of each row, one at a time: of media as they are, else of texts (null: empty)."""
    if "media" in columns:
        for doc_id, n_bytes, media in zip(columns["doc_id"].to_pylist(), columns["n_bytes"].to_pylist(), columns["media"], strict=True):
            yield doc_id, n_bytes, media.as_py()
        return
    ids = iter(columns["doc_id"].to_pylist())
    for _, texts in text_chunks(batch, texts=columns["text"]):
        for text in texts:
            raw = text.as_py()
            yield next(ids), len(raw), to_png(payload_of(raw))


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out, name, at, index = None, "", 0, []
        schema = _INDEX

        def close() -> None:
            if out is None:
                return
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as stream:
                stream.write_batch(pa.RecordBatch.from_pylist(index, schema))
            tail = sink.getvalue().to_pybytes()
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
            done.append((name, at))

        for batch in iterator:
            columns = {n.lower(): batch.column(i) for i, n in enumerate(batch.schema.names)}
            schema = pa.schema([("doc_id", columns["doc_id"].type), *_INDEX])
            for doc_id, n_bytes, body in _members(columns, batch):
                if out is None or at >= ARCHIVE_BYTES:
                    close()
                    name, at, index = f"{uuid.uuid4().hex}.archive", 0, []
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                out.write(body)
                index.append({"doc_id": doc_id, "n_bytes": n_bytes, "offset": at, "length": len(body), "crc32": zlib.crc32(body)})
                at += len(body)
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        before = _manifests(files, root) if self.overwrite else []
        with files.open_output_stream(f"{root}/{uuid.uuid4().hex}{MANIFEST}", compression=None) as out:
            out.write(json.dumps(sorted(a for m in messages if m for a in m.archives)).encode())
        for path in before:
            files.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                files.delete_file(f"{root}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, ids: str = "long", measured: bool = False):
        self.path, self.ids, self.measured = path, ids, measured

    def partitions(self) -> list[ByteRange]:
        files, root = _open(self.path)
        archives = []
        for path in _manifests(files, root):
            with files.open_input_stream(path, compression=None) as file:
                archives += json.loads(file.read())
        step = max(RANGE_BYTES, -(-sum(size for _, size in archives) // MOST_RANGES))
        return [ByteRange(name, first, min(first + step, size)) for name, size in sorted(archives) for first in range(0, size, step)] or [ByteRange("", 0, 0)]

    @staticmethod
    def _member(files: fs.FileSystem, path: str, offset: int, length: int, crc32: int) -> bytes:
        """One member, tried again by itself when its read fails or its checksum is wrong."""
        for attempt in range(TRIES):
            try:
                with files.open_input_file(path) as file:
                    body = file.read_at(length, offset)
                if len(body) == length and zlib.crc32(body) == crc32:
                    return body
                problem: Exception = ValueError(f"{path}: member at {offset} is damaged")
            except OSError as e:
                problem = e
            time.sleep(0.05 * attempt)
        raise problem

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        for batch in self._read(partition):
            yield measure(batch) if self.measured else batch

    def _read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", IDS[self.ids]), ("n_bytes", pa.int64()), ("media", pa.binary())])
        if not partition.archive:
            return
        files, root = _open(self.path)
        path = f"{root}/{partition.archive}"
        with files.open_input_file(path) as file:
            size = file.size()
            n = int.from_bytes(file.read_at(8, size - 8), "big")
            index = pa.ipc.open_stream(file.read_at(n, size - 8 - n)).read_all()
            offsets = index.column("offset").to_numpy()
            first, last = np.searchsorted(offsets, [partition.first, partition.last])
            rows: list[dict] = []
            held = 0
            for r in index.slice(first, last - first).to_pylist():
                body = file.read_at(r["length"], r["offset"])
                if zlib.crc32(body) != r["crc32"]:
                    body = self._member(files, path, r["offset"], r["length"], r["crc32"])
                rows.append({"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "media": body})
                held += len(body)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder); df.write.format("media_archive").mode("append").save(folder).

    Rows to write have doc_id and text, or doc_id, n_bytes and media. The option `id` says of what type the members' ids
    are: long (the default) or string; with `measured`, what the members say (`measure`) is read in place of the media.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return f"doc_id {self.options.get('id', 'long')}, {MEASURES if self._measured() else MEMBER}"

    def _measured(self) -> bool:
        return self.options.get("measured", "false").lower() == "true"

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("id", "long"), self._measured())

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def id_type(docs: DataFrame) -> str:
    """How archives hold the ids of docs."""
    return "long" if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else "string"


def store(docs: DataFrame, folder: str) -> None:
    """Write the texts of docs as members of archives in a new folder. A null text is an empty one; ids that are no whole numbers are kept as texts."""
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), "text").write.format("media_archive").mode("append").save(folder)


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples in thousandths, shares of sixteen brightness bands in per mille, and a 64-bit pattern of which eighth-by-eighth areas are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) * 1000 // len(x)
    spread = int(np.sqrt(float((x.astype(np.int64) ** 2).sum()) / len(x) - (float(x.sum(dtype=np.int64)) / len(x)) ** 2) * 1000)
    bands = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    image = x.reshape(-1, SIDE)
    rows = np.add.reduceat(image.astype(np.int64), np.arange(8) * len(image) // 8, axis=0)
    sums = rows.reshape(8, 8, SIDE // 8).sum(axis=2)
    areas = sums * 8 // np.diff(np.append(np.arange(8) * len(image) // 8, len(image)))[:, None]
    bits = "".join("1" if a > areas.mean() else "0" for a in areas.ravel().tolist())
    return f"mean={mean};spread={spread};bands={','.join(map(str, bands.tolist()))};areas={int(bits, 2):016x}"


def measure(members: pa.RecordBatch) -> pa.RecordBatch:
    """What stored bytes say, for each member (doc_id, n_bytes, media): payload sizes and hashes, the stored form's, and the feature."""
    rows = []
    for n_bytes, member in zip(members.column(1).to_pylist(), members.column(2), strict=True):
        media = member.as_py()
        payload = from_png(media)
        rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
    made = pa.RecordBatch.from_pylist([dict(zip(_MEASURED.names, r, strict=True)) for r in rows], _MEASURED)
    return pa.RecordBatch.from_arrays([members.column(0), *made.columns], names=["doc_id", *_MEASURED.names])


def features(members: DataFrame) -> DataFrame:
    """`measure` of a table of members."""
    return members.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: map(measure, batches), f"doc_id {id_type(members)}, {MEASURES}")


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Store all texts in the shared folder and measure what is read back.

    Null and empty texts are one frame of 255; a doc_id has its type and a null one stays null; repeated rows are members each; other columns
    are not stored; an empty table gives no rows.
    """
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    store(docs, folder)
    read = docs.sparkSession.read.format("media_archive").option("id", id_type(docs)).option("measured", "true").load(folder)
    return read.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import table

    return media_round_trip(table(spark, sf_dir, "documents"))

"""Images packed in zip archives: one file for many images, read in byte ranges.

An image each in a file of its own costs a listing entry, an open and a task's share per
image. Here a task gets a range of an archive's bytes, reads its directory (at the end of
the file) and those members that begin in its range; so one archive of any size is
read by many tasks. Filters on name and length are applied to the directory, before
any content is read.

Paths are those of ``pyarrow.fs``: local ones, and URIs that it knows (s3, gs, hdfs).
"""

from __future__ import annotations

import datetime as dt
import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

SCHEMA = "archive string, name string, modificationTime timestamp, length long, content binary, error string"
SPLIT_BYTES, BATCH_BYTES, ARCHIVE_BYTES = 64 << 20, 16 << 20, 128 << 20
NO_NAME, NO_CONTENT = b"n", b"c"
_ARROW = pa.schema([("archive", pa.string()), ("name", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError)


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


@dataclass
class Range(D.InputPartition):
    path: str
    archive: str
    start: int
    stop: int


def _wanted(filters: list, info: zipfile.ZipInfo, name: str | None, length: int | None) -> bool:
    values = {"name": name, "length": length}
    for f in filters:
        value = values[f.attribute[0]]
        if isinstance(f, D.IsNotNull):
            ok = value is not None
        elif value is None:
            ok = False
        elif isinstance(f, D.EqualTo):
            ok = value == f.value
        elif isinstance(f, D.In):
            ok = value in f.value
        elif isinstance(f, D.StringStartsWith):
            ok = value.startswith(f.value)
        elif isinstance(f, D.GreaterThan):
            ok = value > f.value
        elif isinstance(f, D.GreaterThanOrEqual):
            ok = value >= f.value
        elif isinstance(f, D.LessThan):
            ok = value < f.value
        else:
            ok = value <= f.value
        if not ok:
            return False
    return True


PUSHED = (D.IsNotNull, D.EqualTo, D.In, D.StringStartsWith, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)


def _rows(archive: str, file, start: int, stop: int, filters: list, contents: bool) -> Iterator[tuple]:
    """The members that begin between start and stop. A broken archive is one row
    with an error, from the range that holds its first byte; a broken member is one
    without content."""
    try:
        zipped = zipfile.ZipFile(file)
    except BROKEN as e:
        if start == 0 and not filters:
            yield archive, None, None, None, None, f"no archive: {e}"
        return
    with zipped:
        for info in zipped.infolist():
            if info.is_dir() or not start <= info.header_offset < stop:
                continue
            name = None if NO_NAME in info.comment else info.filename
            length = None if NO_CONTENT in info.comment else info.file_size
            if not _wanted(filters, info, name, length):
                continue
            content = error = None
            if contents and length is not None:
                try:
                    content = zipped.read(info)
                except BROKEN as e:
                    error = f"broken member: {e}"
            time = dt.datetime(*info.date_time, tzinfo=dt.timezone.utc) if 1 <= info.date_time[1] <= 12 and 1 <= info.date_time[2] <= 31 else None
            yield archive, name, time, length, content, error


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"") + 200
        if size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


class PackedReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.contents = options.get("contents", "true").lower() == "true"
        self.filters: list = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, PUSHED) and f.attribute in (("name",), ("length",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, where = _opened(self.path)
        found = fs.get_file_info(where)
        if found.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else sorted((x for x in fs.get_file_info(pyarrow.fs.FileSelector(where, recursive=True)) if x.is_file and x.path.endswith(".zip") and not x.base_name.startswith((".", "_"))), key=lambda x: x.path)
        ranges = [Range(self.path, x.path, a, min(a + self.split, x.size) if a + self.split < x.size else max(x.size, 1)) for x in files for a in range(0, max(x.size, 1), self.split)]
        return ranges or [Range(self.path, "", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:  # there are none
            return
        fs, _ = _opened(part.path)
        with fs.open_input_file(part.archive) as file:
            yield from _batches(_rows(part.archive, file, part.start, part.stop, self.filters, self.contents))


@dataclass
class Written(D.WriterCommitMessage):
    names: list[str]


class PackedWriter(D.DataSourceWriter):
    """A task writes archives below a hidden name; they get theirs when all have ended."""

    def __init__(self, path: str, overwrite: bool, most: int):
        self.path, self.overwrite, self.most, self.job = path, overwrite, most, uuid.uuid4().hex

    def write(self, rows: Iterator[T.Row]) -> Written:
        fs, where = _opened(self.path)
        fs.create_dir(where)
        names: list[str] = []
        zipped, size, stream = None, 0, None
        for row in rows:
            if zipped is None or size >= self.most:
                if zipped is not None:
                    zipped.close()
                    stream.close()
                names.append(f"{self.job}-{uuid.uuid4().hex}.zip")
                stream = fs.open_output_stream(f"{where}/_{names[-1]}")
                zipped, size = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), 0
            info = zipfile.ZipInfo(row["name"] or "-", (2000, 1, 1, 0, 0, 0))
            info.comment = (NO_NAME if row["name"] is None else b"") + (NO_CONTENT if row["content"] is None else b"")
            zipped.writestr(info, bytes(row["content"] or b""))
            size += len(row["content"] or b"") + 200
        if zipped is not None:
            zipped.close()
            stream.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, where = _opened(self.path)
        fs.create_dir(where)
        before = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(where)) if x.is_file and not x.base_name.startswith("_")] if self.overwrite else []
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{where}/_{name}", f"{where}/{name}")
        for path in before:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, where = _opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{where}/_{name}")


class PackedImages(D.DataSource):
    """Format ``packed_images``. Options: splitBytes (a task's range), contents (false:
    names and lengths only, nothing else is read), archiveBytes (when writing)."""

    @classmethod
    def name(cls) -> str:
        return "packed_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PackedReader:
        return PackedReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> PackedWriter:
        options = {k.lower(): v for k, v in self.options.items()}
        return PackedWriter(options["path"], overwrite, int(options.get("archivebytes", ARCHIVE_BYTES)))


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(PackedImages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def packed_images(spark: SparkSession, path: str, **options) -> DataFrame:
    """archive, name, modificationTime, length, content and error of each image in
    the archives (*.zip) below path, or in the archive path.

    A member whose content can't be read (checksum, compression) has null content and
    an error; a file that is no archive gives one row with an error and no name. Members
    that share a name are rows of their own; directories aren't rows. Compare names
    and lengths with constants to have them pushed down."""
    _registered(spark)
    return spark.read.format("packed_images").options(**options).load(path)


def write_packed(images: DataFrame, path: str, name_col: str = "name", content_col: str = "content", mode: str = "append", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes images into archives of about archive_bytes, one task at a time into its
    own; nothing of a job that fails is seen by readers. A null name or content is
    kept as null."""
    _registered(images.sparkSession)
    rows = images.select(images[name_col].cast("string").alias("name"), images[content_col].cast("binary").alias("content"))
    rows.write.format("packed_images").option("archiveBytes", archive_bytes).mode(mode).save(path)


def members(archives: DataFrame) -> DataFrame:
    """The same rows from archives that are whole in a column content (with path), as
    Spark's binary files give them, in a batch or a stream. Keep such archives small:
    each is in memory whole."""

    def unpack(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if content is not None:
                    yield from _batches(_rows(path, io.BytesIO(content), 0, len(content) + 1, [], True))

    return archives.select("path", "content").mapInArrow(unpack, SCHEMA)

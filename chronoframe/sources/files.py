"""Data sources for the files around recordings: reading caption files, and writing one text file per recording.

spark.dataSource.register makes them known: `captions` reads, `recording_files` writes. Both reach what pyarrow reaches (local and mounted folders, S3,
HDFS where its library is installed); media.caption_files reads the same through Spark's own readers.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _lowered(options: dict) -> dict:
    """Names of options do not depend on case."""
    return {k.lower(): v for k, v in options.items()}


def lenient(content: bytes) -> str:
    """UTF-8 as text; bytes that are not part of a whole character are left out."""
    return content.decode("utf-8", errors="ignore")


@dataclass
class Files(InputPartition):
    paths: list[str]


class CaptionReader(DataSourceReader):
    """Files are listed once on the driver, by name and size only, and read where their partition runs."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("captions: set the option path to a folder")
        self.path, self.pattern = options["path"], options.get("pattern", "*.vtt")
        self.by_stem, self.most = options.get("id", "folder") == "stem", int(options.get("maxpartitionbytes", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        system, base = located(self.path)
        found = sorted((f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern) and "/_staging-" not in f.path), key=lambda f: f.path)
        parts, size = [Files([])], 0
        for f in found:
            if parts[-1].paths and size + f.size > self.most:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(f.path)
            size += f.size
        return parts

    def read(self, partition: Files) -> Iterator[tuple[str, str, str]]:
        system, _ = located(self.path)
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as f:
                text = lenient(f.read())
            folder, name = posixpath.split(path)
            yield unquote(name.rpartition(".")[0]) if self.by_stem else posixpath.basename(folder), name, text


class Captions(DataSource):
    """video_id, name, value: whole caption files. Options: path, pattern (*.vtt), id (folder: that of the file; stem: the file's name), maxPartitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "captions"

    def schema(self) -> str:
        return "video_id string, name string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaptionReader(_lowered(self.options))


@dataclass
class Folder(WriterCommitMessage):
    """What one task has written."""

    name: str
    files: int


class FilesWriter(DataSourceWriter):
    """Every task writes into a folder of its own under a staging folder; commit moves whole folders, one per task, into place, abort deletes them.

    The driver hears of folders, never of files. A task that runs twice leaves two folders, of which the one that is reported counts.
    """

    def __init__(self, options: dict, overwrite: bool):
        if not options.get("path"):
            raise ValueError("recording_files: set the option path to a folder")
        self.path, self.extension, self.separator = options["path"].rstrip("/"), options.get("extension", "md"), options.get("linesep", "\n").encode()
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base}/_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Folder:
        system, base = located(self.path)
        name = f"part-{uuid.uuid4().hex}"
        folder, current, out, done = f"{self._staging(base)}/{name}", None, None, set()
        try:
            for key, line in iterator:
                if key is None:
                    raise ValueError("recording_files: a row has no recording")
                if key != current:
                    if key in done:
                        raise ValueError(f"recording_files: rows of {key!r} are not together")
                    if out is not None:
                        out.close()
                    else:
                        system.create_dir(folder, recursive=True)
                    out, current = system.open_output_stream(f"{folder}/{quote(key, safe='')}.{self.extension}"), key
                    done.add(key)
                out.write((b"" if line is None else bytes(line) if isinstance(line, bytes | bytearray) else line.encode()) + self.separator)
        finally:
            if out is not None:
                out.close()
        return Folder(name, len(done))

    def commit(self, messages: list[Folder | None]) -> None:
        system, base = located(self.path)
        system.create_dir(base, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.files:
                system.move(f"{self._staging(base)}/{m.name}", f"{base}/{m.name}")
        for path in old:
            system.delete_dir(path)
        self._clear()
        system.open_output_stream(f"{base}/_SUCCESS").close()

    def abort(self, messages: list[Folder | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = located(self.path)
        if system.get_file_info(self._staging(base)).type != fs.FileType.NotFound:
            system.delete_dir(self._staging(base))


class RecordingFiles(DataSource):
    """Writes rows (recording STRING, line STRING or BINARY) to a file per recording. Options: path, extension (md), lineSep (a line feed).

    Rows of a recording must come together, as `save_files` sees to.
    """

    @classmethod
    def name(cls) -> str:
        return "recording_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.dataType.typeName() for f in schema.fields] not in (["string", "string"], ["string", "binary"]):
            raise ValueError(f"recording_files: rows are (STRING, STRING or BINARY), not {schema.simpleString()}")
        return FilesWriter(_lowered(self.options), overwrite)


def register(spark: SparkSession) -> None:
    for source in (Captions, RecordingFiles):
        spark.dataSource.register(source)


def save_files(rows: DataFrame, path: str, order: list[str], key: str = "video_id", line: str = "line", extension: str = "md", separator: str = "\n", overwrite: bool = False, together: bool = False) -> None:
    """A file of its lines, in order, for each recording: folders part-*/ under the path hold <recording>.<extension>.

    Recordings are dealt out by key and their rows sorted in their task, which writes one row after the other: no recording is held in memory.
    Rows without a recording are left out; a null line is an empty one. together: rows come from a window over the key, so each
    recording's are in one task already and only sorted.
    """
    register(rows.sparkSession)
    kept = rows.where(rows[key].isNotNull())
    dealt = (kept if together else kept.repartition(key)).sortWithinPartitions(key, *order)
    dealt.select(dealt[key].cast("string").alias("recording"), dealt[line].alias("line")).write.format("recording_files").option("extension", extension).option("lineSep", separator).mode("overwrite" if overwrite else "append").save(path)


def read_captions(spark: SparkSession, path: str, pattern: str = "*.vtt", by: str = "folder") -> DataFrame:
    register(spark)
    return spark.read.format("captions").option("pattern", pattern).option("id", by).load(path)


#: Bytes of small files that are handed over at once.
_TOGETHER = 4 << 20
#: Bytes from which a file is large.
_LARGE = 64 << 20


def _stem(path: str) -> str:
    """The name of a recording, from that of its file."""
    return unquote(posixpath.basename(path).rpartition(".")[0])


def groups(sizes: dict[str, int]) -> dict[str, int]:
    """A group's number for each name: few groups, none larger than the largest size, the largest first."""
    room, out = [], {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = next((k for k, r in enumerate(room) if r >= size), len(room))
        if k == len(room):
            room.append(max(sizes.values()))
        room[k] -= size
        out[name] = k
    return out


def _text_batch(names: list[str], buffers: list[pa.Buffer]) -> pa.RecordBatch:
    """Names and UTF-8 contents; the buffer of a single file is passed on as it is."""
    ends = [0]
    for b in buffers:
        ends.append(ends[-1] + b.size)
    data = buffers[0] if len(buffers) == 1 else pa.py_buffer(b"".join(buffers))
    texts = pa.Array.from_buffers(pa.string(), len(buffers), [None, pa.py_buffer(pa.array(ends, pa.int32()).buffers()[1]), data])
    return pa.record_batch([pa.array(names, pa.string()), texts], ["video_id", "value"])


def whole_files(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """video_id, value: the UTF-8 files that `save_files` wrote, each a row, found by a pattern of paths.

    Spark lists the files and deals them out by size; their content goes from the file to its row without the copies that Spark's text reader
    makes, which take several times a large file. A row, and so a file, can hold 2 GB less one byte at most. large: rows of large
    files are dealt out anew once they are made, in as few groups as the largest row allows. What reads them then holds a row of the size that it
    has, while one just made sits in a buffer of twice that size beside its content from Python, and few large rows are held at once.
    """

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, buffers = [], []
            for uri in batch.column(0).to_pylist():
                system, at = located(quote(uri, safe=":/"))  # Spark gives names as they are
                if isinstance(system, fs.LocalFileSystem):
                    system = fs.LocalFileSystem(use_mmap=True)
                with system.open_input_file(at) as f:
                    content = f.read_buffer()
                if buffers and sum(b.size for b in buffers) + content.size > _TOGETHER:
                    yield _text_batch(names, buffers)
                    names, buffers = [], []
                names.append(_stem(at))
                buffers.append(content)
                del content
            if buffers:
                yield _text_batch(names, buffers)

    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    whole = listed.select("path").mapInArrow(contents, "video_id string, value string")
    sizes = {_stem(r["path"]): r["length"] for r in listed.where(F.col("length") >= _LARGE).collect()} if large else {}
    if not sizes:
        return whole
    found = groups(sizes)
    known = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
    # without a column for its group, which would have to be taken out of each row and the row be copied
    return whole.repartitionById(max(found.values()) + 1, F.coalesce(F.try_element_at(known, F.col("video_id")), F.hash("video_id")))

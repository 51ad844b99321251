"""Folders of text files as a Python data source, batch and stream.

``spark.read.format("tessera_text")`` (after ``register``) lists a folder once,
deals the files out over tasks by bytes, so that many small files share a task,
and returns one row per text part and one row per file that could not be read,
with the reason.  The stream keeps its list of files in a log folder: an offset
is a number of log entries, so a restarted query sees the same files in the same
batches, and no file twice.

Options: ``path`` (a file or a folder, read recursively; any place that Arrow's
file systems reach), ``extensions`` (comma-separated, any case), ``separator``
(parts of a file; without it the file is one part), ``bytesPerTask``,
``onError`` (``skip`` gives the row with the reason, ``raise`` fails), and
``log`` for the stream.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "tessera_text"
SCHEMA = "path string, part long, text string, bytes long, reason string"
BYTES_PER_TASK = 32 << 20
ROWS_PER_BATCH, BYTES_PER_BATCH = 1024, 1 << 20     # a batch ends with the file that reaches one of them


def open_path(uri: str):
    """The Arrow file system of ``uri`` and the path inside it."""
    from pyarrow import fs
    if re.match(r"file:/", uri) or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def list_files(uri: str, extensions) -> list[tuple[str, int]]:
    """(path, bytes) of the files with one of the extensions, in path order.  A
    file that is named itself must have one of them."""
    from pyarrow import fs
    files, root = open_path(uri)
    info = files.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    wanted = lambda path: path.lower().endswith(tuple(extensions))
    if info.type == fs.FileType.File:
        if not wanted(root):
            raise ValueError(f"unsupported file type: {uri}")
        return [(root, info.size)]
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and wanted(f.path))


class Files(InputPartition):
    """The files of one task."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def dealt(files: list[tuple[str, int]], bytes_per_task: int) -> list[Files]:
    """Files in path order, as many in one task as fit into ``bytes_per_task``
    (a larger file alone); an empty file counts as one KB of work."""
    out: list = []
    room = 0
    for path, size in files:
        work = max(size, 1024)
        if work > room or not out:
            out.append([])
            room = max(bytes_per_task, 1)
        out[-1].append((path, size))
        room -= work
    return [Files(x) for x in out]


def parts_of(data: bytes, separator: str | None) -> list[str]:
    """Texts of a file: strict UTF-8, line ends as ``\\n``; what follows the last
    separator counts only if it is not empty, unless it is all there is."""
    text = data.decode("utf-8")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not separator:
        return [text]
    parts = text.split(separator)
    return parts[:-1] if len(parts) > 1 and not parts[-1] else parts


def read_files(uri: str, files, separator: str | None, on_error: str):
    """Arrow batches of SCHEMA for the files."""
    import pyarrow as pa
    system, _ = open_path(uri)
    names = ["path", "part", "text", "bytes", "reason"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    rows: list = [[] for _ in names]
    held = 0

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)
        for c in rows:
            c.clear()
        return out
    for path, size in files:
        try:
            with system.open_input_stream(path, compression=None) as f:
                found = [(path, i, t, size, None) for i, t in enumerate(parts_of(f.read(), separator))]
        except UnicodeDecodeError as e:
            if on_error == "raise":
                raise ValueError(f"invalid utf-8 in {path} at byte {e.start}") from None
            found = [(path, None, None, size, f"invalid utf-8 at byte {e.start}")]
        except OSError as e:
            if on_error == "raise":
                raise
            found = [(path, None, None, size, f"unreadable: {type(e).__name__}")]
        for row in found:
            for c, v in zip(rows, row):
                c.append(v)
        del found
        held += size
        if len(rows[0]) >= ROWS_PER_BATCH or held >= BYTES_PER_BATCH:
            yield batch()
            held = 0
    if rows[0]:
        yield batch()


class _Options:
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        if "path" not in o:
            raise ValueError("option path is missing")
        self.path, self.separator = o["path"], o.get("separator")
        self.extensions = [e.strip().lower() for e in o.get("extensions", ".txt,.md,.markdown").split(",")]
        self.bytes_per_task = int(o.get("bytespertask", BYTES_PER_TASK))
        self.on_error, self.log = o.get("onerror", "skip"), o.get("log")
        if self.on_error not in ("skip", "raise"):
            raise ValueError("onError must be 'skip' or 'raise'")


class TextFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BatchReader(_Options(self.options))

    def streamReader(self, schema):
        return StreamReader(_Options(self.options))


class BatchReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self):
        o = self.options
        return dealt(list_files(o.path, o.extensions), o.bytes_per_task) or [Files([])]

    def read(self, partition):
        yield from read_files(self.options.path, partition.files, self.options.separator, self.options.on_error)


class StreamReader(DataSourceStreamReader):
    """Offsets count entries of the log; an entry is the list of files that were
    new when it was written.  An entry is written under another name and then
    renamed, so it is there whole or not at all."""

    def __init__(self, options: _Options):
        if not options.log:
            raise ValueError("option log is missing: a folder that the driver keeps the list of files in")
        self.options, self.seen, self.entries = options, set(), 0

    def _entry(self, n: int):
        files, root = open_path(self.options.log)
        with files.open_input_stream(f"{root}/{n:08d}.json", compression=None) as f:
            return [(p, s) for p, s in json.loads(f.read())]

    def _catch_up(self):
        from pyarrow import fs
        files, root = open_path(self.options.log)
        while files.get_file_info(f"{root}/{self.entries + 1:08d}.json").type == fs.FileType.File:
            self.entries += 1
            self.seen.update(p for p, _ in self._entry(self.entries))

    def initialOffset(self):
        return {"entries": 0}

    def latestOffset(self):
        self._catch_up()
        new = [f for f in list_files(self.options.path, self.options.extensions) if f[0] not in self.seen]
        if new:
            files, root = open_path(self.options.log)
            files.create_dir(root, recursive=True)
            made = f"{root}/.{self.entries + 1:08d}.tmp"
            with files.open_output_stream(made, compression=None) as f:
                f.write(json.dumps(new).encode())
            files.move(made, f"{root}/{self.entries + 1:08d}.json")
            self._catch_up()
        return {"entries": self.entries}

    def partitions(self, start, end):
        found = [f for n in range(start["entries"] + 1, end["entries"] + 1) for f in self._entry(n)]
        return dealt(found, self.options.bytes_per_task) or [Files([])]

    def read(self, partition):
        yield from read_files(self.options.path, partition.files, self.options.separator, self.options.on_error)


def register(spark: SparkSession) -> None:
    """Make the format known to the session (the thread's active one, as Spark looks
    formats up there); a session that knows it stays as it is."""
    try:
        spark.dataSource.register(TextFiles)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def _with(reader, path: str, separator, extensions, bytes_per_task, on_error):
    r = reader.format(FORMAT).option("path", path).option("bytesPerTask", bytes_per_task).option("onError", on_error)
    if extensions:
        r = r.option("extensions", ",".join(extensions))
    return r.option("separator", separator) if separator else r


def read_text_files(spark: SparkSession, path: str, separator: str | None = None, extensions=None,
                    bytes_per_task: int = BYTES_PER_TASK, on_error: str = "skip") -> DataFrame:
    """(path, part, text, bytes, reason) of a folder: texts, and files refused with the reason."""
    register(spark)
    return _with(spark.read, path, separator, extensions, bytes_per_task, on_error).load()


def stream_text_files(spark: SparkSession, path: str, log: str, separator: str | None = None, extensions=None,
                      bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """The same for files as they arrive; ``log`` belongs to one stream, like its checkpoint."""
    register(spark)
    return _with(spark.readStream, path, separator, extensions, bytes_per_task, "skip").option("log", log).load()

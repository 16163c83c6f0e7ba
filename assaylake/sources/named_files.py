"""A data source that writes files under names of their own (SNK11, SNK12), and directories of many files
listed and read by tasks.

``df.write.format("named_files").mode("append").save(path)`` takes rows of ``name`` and ``content``. Rows of one name that follow
each other in a task become one file, so a task holds one row at a time whatever a file's size. A task
writes below a staging folder, in parts by a hash of the name, as the commit lists a part at a time; the driver's
commit moves the files of the tasks that count to their names, several parts at a time, and an aborted job leaves no file under a name. Tasks that still run when
their job is aborted may leave some in its staging folder, which readers skip for its underscore and the
next overwrite removes. The writer reaches the file systems that pyarrow knows by the path's scheme.
"""

import os
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from io import BufferedWriter
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "named_files"
#: Folders whose files the commit moves at a time; a local disk moves one file after the other between folders.
MOVERS, LOCAL_MOVERS = 16, 2
#: Parts of a task's folder at most, so that what the commit lists at a time does not grow with a task's files alone.
PARTS = 256
#: Files that a task reads, and the bytes of them that it holds.
READ_FILES, READ_BYTES = 10_000, 16 << 20
#: What Java leaves as it is in the path of a URI; Python leaves letters, digits and ``_.-~``.
_UNQUOTED = "/;:@&=+$,!*'()"


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files, and the parts of it that have some where it is divided."""

    folder: str
    parts: tuple[int, ...] = ()

    def homes(self) -> list[str]:
        return [f"{self.folder}/{part}" for part in self.parts] or [self.folder]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> "NamedFilesWriter":
        if sorted(schema.names) != ["content", "name"]:
            raise ValueError(f"named files need the columns name and content, not {schema.names}")
        return NamedFilesWriter(self.options["path"], overwrite)


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context, (files, root) = TaskContext.get(), opened(self.path)
        folder = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        current, out, made, parts = None, None, set(), set()
        try:
            for batch in iterator:
                names, contents = batch.column("name"), batch.column("content")
                for name, content in zip(names, contents, strict=True):
                    name = name.as_py()
                    if name != current:
                        if out is not None:
                            out.close()
                        part = zlib.crc32((name or "").encode("utf-8")) % PARTS  # rows of one name meet in one
                        parts.add(part)
                        current, out = name, _create(files, f"{root}/{folder}/{part}", name, made)
                    if content.is_valid:
                        out.write(content.as_buffer())
        except BaseException:
            if out is not None:
                out.close()
            files.delete_dir_contents(f"{root}/{folder}", missing_dir_ok=True)
            raise
        if out is not None:
            out.close()
        return Written(folder, tuple(sorted(parts)))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root)):
                if old.base_name != self.staging:
                    files.delete_dir(old.path) if old.type == fs.FileType.Directory else files.delete_file(old.path)
        folders = [f"{root}/{home}" for message in messages if message is not None for home in message.homes()]
        local = isinstance(files, fs.LocalFileSystem)
        with ThreadPoolExecutor(LOCAL_MOVERS if local else MOVERS) as movers:
            for _ in movers.map(lambda home: _move_all(files, home, root), folders):
                pass
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


def _move_all(files: fs.FileSystem, home: str, root: str) -> None:
    """Move the files below a folder to their names, one of its folders at a time."""
    todo = [home]
    while todo:
        folder = todo.pop()
        parent = root + folder[len(home) :]
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        todo += [file.path for file in found if file.type == fs.FileType.Directory]
        moved = [file for file in found if file.type == fs.FileType.File]
        if moved:
            files.create_dir(parent, recursive=True)
        for file in moved:
            files.move(file.path, f"{parent}/{file.base_name}")


def _create(files: fs.FileSystem, folder: str, name: str | None, made: set[str]) -> pa.NativeFile | BufferedWriter:
    parts = (name or "").split("/")
    if not all(parts) or any(p in (".", "..") for p in parts):
        raise ValueError(f"not a file's name: {name!r}")
    path = "/".join([folder, *parts])
    parent = path.rpartition("/")[0]
    if parent not in made:
        files.create_dir(parent, recursive=True)
        made.add(parent)
    try:
        if isinstance(files, fs.LocalFileSystem):  # one call, where pyarrow takes three
            return open(path, "xb")
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return files.open_output_stream(path, compression=None)
    except FileExistsError:
        pass
    raise ValueError(f"the rows of {name!r} do not follow each other")


def write_named(df: DataFrame, path: str, *order: str, rows_per_name: int | None = None) -> None:
    """Replace what is below ``path`` by a file for each name in ``df``, its rows in an order. With
    one row per name nothing is shuffled."""
    df.sparkSession.dataSource.register(NamedFiles)
    if rows_per_name != 1:
        df = df.repartition("name").sortWithinPartitions("name", *order)
    df.select("name", "content").write.format(FORMAT).mode("overwrite").save(path)


def read_files(spark: SparkSession, directory: str, glob: str, recursive: bool = False) -> DataFrame | None:
    """``path, content`` of the files in a directory whose names match, as Spark's binary source gives them, but
    listed by a task and read by others, so that the driver holds nothing for a file. As there, empty files give no
    row. None where ``directory``
    is not one that pyarrow knows, as a pattern of paths."""
    try:
        files, root = opened(directory)
        if files.get_file_info(root).type != fs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    home = jvm.org.apache.hadoop.fs.Path(directory)
    home = home.getFileSystem(conf).makeQualified(home).toUri().toString().rstrip("/").replace("file:///", "file:/")
    names = spark.range(0, 1, 1, 1).mapInArrow(_lister(directory, glob, recursive), "name string")
    found = names.count()
    tasks = min(spark.sparkContext.defaultParallelism, found // 100 + 1)
    names = names.repartition(max(tasks, found // READ_FILES + 1), "name")
    return names.mapInArrow(_reader(directory, home), "path string, content binary")


def _lister(directory: str, glob: str, recursive: bool) -> Callable:
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(directory)
        held = []
        for batch in batches:
            for name in _names(files, root, glob, recursive) if batch.num_rows else ():
                held.append(name)
                if len(held) == READ_FILES:
                    yield pa.record_batch([pa.array(held, pa.string())], ["name"])
                    held = []
        yield pa.record_batch([pa.array(held, pa.string())], ["name"])

    return names


def _names(files: fs.FileSystem, root: str, glob: str, recursive: bool) -> Iterator[str]:
    """Paths below a directory, of what Spark would read: hidden files are left out, and folders but for those of
    a partition."""
    todo = [""]
    while todo:
        below = todo.pop()
        for name, is_folder in _entries(files, f"{root}/{below}"):
            if name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"):
                continue
            if is_folder:
                todo += [f"{below}{name}/"] if recursive or "=" in name else []
            elif fnmatchcase(name, glob):
                yield below + name


def _entries(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder and which are folders; on a local disk one at a time."""
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                yield entry.name, entry.is_dir()
    else:
        for file in files.get_file_info(fs.FileSelector(folder.rstrip("/"))):
            yield file.base_name, file.type == fs.FileType.Directory


def _reader(directory: str, home: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(directory)
        for batch in batches:
            paths, contents, size = [], [], 0
            for name in batch.column("name").to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as file:
                    content = file.read()
                if not content:
                    continue
                contents.append(content)
                paths.append(f"{home}/{_quoted(name)}")
                size += len(content)
                if size >= READ_BYTES:
                    yield _files(paths, contents)
                    paths, contents, size = [], [], 0
            yield _files(paths, contents)

    return read


def _quoted(name: str) -> str:
    """As in a URI of Java, where letters beyond ASCII stand as they are."""
    return "".join(c if ord(c) > 127 else quote(c, _UNQUOTED) for c in name)


def _files(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

"""Data sources of delimited recordings: a reader with own listing and one pass a file, and a sink of one file a key.

``spark.read.format("recordings").option("rows", "files" | "layout" | "samples").load(path)``, after :func:`register`.
"""

from __future__ import annotations

import codecs
import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pf
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sphygmo.functions.layout import Layout, laid_out

LAYOUT = "delimiter string, header_no int, data_start int, columns array<string>, stats array<struct<name:string,n:long,first:double,last:double,rising:boolean>>, metadata array<struct<key:string,value:string>>, n_rows long, error string"
#: What each kind of row has.
ROWS = {
    "files": "file_path string, file_size_bytes long, state string, encoding string, head string, digest string",
    "layout": f"file_path string, {LAYOUT}",
    "samples": "file_path string, idx long, columns array<string>, v array<double>",
}
#: Files up to this size are held while they are read; larger ones are streamed, once for each pass.
HELD = 64 << 20
#: Small files share a partition up to this size.
TOGETHER = 64 << 20
#: Lines and characters of a text that tell what it is.
HEAD_LINES, HEAD_CHARS = 20, 2048


def file_system(path: str) -> tuple[pf.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what stood before it."""
    if m := re.match(r"file:/*", path):
        return pf.LocalFileSystem(), "/" + path[m.end() :], ""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        fs, inner = pf.FileSystem.from_uri(path)
        return fs, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return pf.LocalFileSystem(), path, ""


@dataclass
class Files(InputPartition):
    """Some files (path, size), and the paths that are wanted of those in them (None: all)."""

    files: list[tuple[str, int]]
    only: frozenset[str] | None


class Text:
    """A text that is read from its start as often as needed."""

    def __init__(self, opened, size: int) -> None:
        self.opened, self.held = opened, None
        if size <= HELD:
            with opened() as f:
                self.held = f.read()

    def stream(self):
        return io.BytesIO(self.held) if self.held is not None else self.opened()

    def chunks(self) -> Iterator[bytes]:
        with self.stream() as f:
            while part := f.read(1 << 20):
                yield part

    def encoding(self) -> str:
        """UTF-8 if the bytes are, UTF-16 if they are and begin with its mark, else Latin-1, which any bytes are."""
        first = next(self.chunks(), b"")
        for name in ("utf-8", *(["utf-16"] if first[:2] in (b"\xff\xfe", b"\xfe\xff") else [])):
            decoder = codecs.getincrementaldecoder(name)()
            try:
                for part in self.chunks():
                    decoder.decode(part)
                decoder.decode(b"", True)
                return name
            except UnicodeDecodeError:
                continue
        return "latin-1"

    def lines(self, encoding: str) -> Iterator[str]:
        with io.TextIOWrapper(io.BufferedReader(self.stream()), encoding=encoding) as f:
            yield from f

    def head(self, encoding: str) -> str:
        found = list(islice(self.lines(encoding), HEAD_LINES))
        with io.TextIOWrapper(io.BufferedReader(self.stream()), encoding=encoding) as f:
            start = f.read(HEAD_CHARS)
        return max("".join(found), start, key=len)


def layout_row(found: Layout) -> dict:
    stats = [{"name": c.name, "n": c.numbers, "first": c.first, "last": c.last, "rising": c.rising} for c in found.columns]
    metadata = [{"key": k, "value": v} for k, v in found.metadata]
    return {"delimiter": found.by, "header_no": found.header_no if found.header_no >= 0 else None, "data_start": found.start, "columns": [c.name for c in found.columns], "stats": stats, "metadata": metadata, "n_rows": found.n_rows, "error": found.error}


class RecordingReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.rows, self.path, self.only = options.get("rows", "files"), options["path"], options.get("only")
        self.names = [f.name for f in schema.fields]
        self.kinds = to_arrow_schema(schema)

    def partitions(self) -> list[Files]:
        """All files under the path, at any depth; names that begin with a dot and cache folders are passed over. Empty files
        and those whose names begin with an underscore are listed too. Small files go together."""
        fs, inner, before = file_system(self.path)
        info = fs.get_file_info(inner)
        if info.type == pf.FileType.NotFound:
            return [Files([(self.path, -1)], None)]
        if info.type == pf.FileType.File:
            found = [info]
        else:
            found = [f for f in fs.get_file_info(pf.FileSelector(inner, recursive=True)) if f.type == pf.FileType.File and not f.base_name.startswith(".") and "__pycache__" not in f.path.rsplit("/", 1)[0]]
        every = sorted((before + f.path, f.size) for f in found)
        only = None
        if self.only:  # a written table of paths
            where, folder, _ = file_system(self.only)
            only = frozenset(ds.dataset(folder, filesystem=where, format="parquet").to_table(columns=["file_path"]).column(0).to_pylist())
            # members of archives are named by their archive's path
            above = {p[:k] for p in only for k in (len(p), *(m.start() for m in re.finditer("/", p)))}
            every = [x for x in every if x[0] in above]
        out: list[Files] = []
        room = 0
        for path, size in every:
            if room <= 0:
                out.append(Files([], None if only is None else frozenset()))
                room = TOGETHER
            out[-1].files.append((path, size))
            room -= max(size, 1 << 16)
        if only is not None:
            for p in out:
                own = {path for path, _ in p.files}
                p.only = frozenset(x for x in only if any(x[:k] in own for k in (len(x), *(m.start() for m in re.finditer("/", x)))))
        return out

    def texts(self, partition: Files) -> Iterator[tuple[str, int, str, Text | None]]:
        """(path, size, state, text) of the files, those in archives in their archive's place."""
        wanted = lambda p: partition.only is None or p in partition.only
        for path, size in partition.files:
            if size < 0:
                yield path, 0, "gone", None
                continue
            fs, inner, _ = file_system(path)
            with fs.open_input_stream(inner) as f:
                start = f.read(4)
            if start != b"PK\x03\x04":
                if wanted(path):
                    yield path, size, "ok", Text(lambda fs=fs, inner=inner: fs.open_input_stream(inner), size)
                continue
            try:
                with fs.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                    for m in z.infolist():
                        name = m.filename
                        if not name.endswith("/") and not name.rsplit("/", 1)[-1].startswith(".") and "__pycache__" not in name and wanted(f"{path}/{name}"):
                            yield f"{path}/{name}", m.file_size, "ok", Text(lambda z=z, name=name: z.open(name), m.file_size)
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter for archives that end before their directory
                if wanted(path):
                    yield path, size, "zip", None

    def batch(self, columns: dict[str, list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[n], self.kinds.field(n).type) for n in self.names], schema=self.kinds)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, size, state, text in self.texts(partition):
            if self.rows == "files":
                row = {"file_path": [path], "file_size_bytes": [size], "state": [state], "encoding": [None], "head": [None], "digest": [None]}
                if text is not None:
                    digest = hashlib.sha256()
                    for part in text.chunks():
                        digest.update(part)
                    encoding = text.encoding()
                    row |= {"encoding": [encoding], "head": [text.head(encoding)], "digest": [digest.hexdigest()]}
                yield self.batch(row)
            elif text is not None:
                encoding = text.encoding()
                lines = lambda text=text, encoding=encoding: text.lines(encoding)
                found = laid_out(lines, name=path)
                if self.rows == "layout":
                    yield self.batch({"file_path": [path], **{k: [v] for k, v in layout_row(found).items()}})
                elif found.columns:
                    values, names, done = found.rows(lines), [c.name for c in found.columns], 0
                    while part := list(islice(values, 4096)):
                        n = len(part)
                        yield self.batch({"file_path": [path] * n, "idx": list(range(done, done + n)), "columns": [names] * n if "columns" in self.names else [], "v": part})
                        done += n


class RecordingSource(DataSource):
    """Options: ``path`` (any URI that Arrow's file systems know); ``rows``: ``files``, ``layout`` or ``samples``; ``only``: a
    Parquet table of the paths that are wanted (file_path). With a schema of fewer columns only those are made.

    ``files`` is one row a file, with ``state`` ``gone`` for a path that is not there and ``zip`` for an archive that cannot be
    read; ``layout`` how each file is laid out; ``samples`` its data without gaps, all columns, one row a line.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return ROWS[self.options.get("rows", "files")]

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(schema, dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they are for now, and where they belong."""

    moves: list[tuple[str, str]]


class KeyedTextWriter(DataSourceWriter):
    """Lines (file, ord, line), sorted by file and ord within a partition, a file's lines in one partition."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, inner, _ = file_system(self.temporary)
        own, now, out, moves = f"{inner}/{uuid.uuid4().hex}", None, None, []
        fs.create_dir(own, recursive=True)
        try:
            for row in iterator:
                if row["file"] != now:
                    if out is not None:
                        out.close()
                    now = row["file"]
                    if now.startswith("/") or ".." in now.split("/"):
                        raise ValueError(f"{now} is no path below the folder")
                    moves.append((f"{own}/{len(moves)}", now))
                    out = fs.open_output_stream(moves[-1][0])
                out.write(f"{row['line']}\n".encode())
        finally:
            if out is not None:
                out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        """Files take their places only when all tasks are done; a task that ran twice has one place to take."""
        fs, inner, _ = file_system(self.folder)
        for temporary, name in (x for m in messages if m is not None for x in m.moves):
            at = f"{inner}/{name}"
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            fs.move(temporary, at)
        fs.delete_dir(file_system(self.temporary)[1]) if fs.get_file_info(file_system(self.temporary)[1]).type == pf.FileType.Directory else None

    def abort(self, messages: list[Written | None]) -> None:
        fs, inner, _ = file_system(self.temporary)
        if fs.get_file_info(inner).type == pf.FileType.Directory:
            fs.delete_dir(inner)


class KeyedTextSink(DataSource):
    """A text file for each value of ``file`` (a path below the folder), its lines by ``ord``."""

    @classmethod
    def name(cls) -> str:
        return "keyed_text"

    def schema(self) -> str:
        return "file string, ord long, line string"

    def writer(self, schema: StructType, overwrite: bool) -> KeyedTextWriter:
        return KeyedTextWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (RecordingSource, KeyedTextSink):
        spark.dataSource.register(source)


def write_keyed(lines, folder: str) -> None:
    """Writes rows (file, ord, line) as one file each, by :class:`KeyedTextSink`; any number of files a task."""
    register(lines.sparkSession)
    dealt = lines.select("file", "ord", "line").repartition("file").sortWithinPartitions("file", "ord")
    dealt.write.format("keyed_text").mode("append").save(folder)

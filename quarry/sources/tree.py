"""A source tree as a Spark data source that outlives bad files.

``spark.read.format("source_tree").option("root", uri)`` lists a tree below
any file system that pyarrow opens from its URI and gives one row per file:
``path`` (from the root's own name on), ``repo``, ``rel_path``, ``size_bytes``,
``content`` and ``read_error``.  A file or folder that can't be read gives a
row with ``read_error`` and null content, and the job goes on; so does a file
over ``maxFileBytes``.

* Filters on path, repo and size_bytes are pushed into the listing: folders
  outside a wanted repository or path prefix are not listed.
* Partitions are planned by bytes (``maxPartitionBytes``), whole files each.
* ``content=false`` leaves content out: a metadata-only scan that opens no
  file.  ``read_listed`` reads the text of listed files that stay after
  filters and joins.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
                                    LessThan, LessThanOrEqual, StringStartsWith)

from quarry.functions import text as TX
from quarry.sources.corpus import FILES_COLUMNS

LISTING = "path string, repo string, rel_path string, size_bytes long, uri string, read_error string"
MAX_PARTITION_BYTES, MAX_FILE_BYTES = 32 << 20, 512 << 20
#: Bytes of text in one Arrow batch, and folders below one another (a loop of links ends there).
BATCH_BYTES, DEEPEST = 8 << 20, 64


def fold(raw: bytes) -> str:
    """Invalid UTF-8 dropped, line ends folded."""
    return raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def read_text(fs, path: str, size: int, most: int) -> tuple[str | None, str | None]:
    """(text, error) of one file; never raises for what the file is."""
    if size > most:
        return None, f"{size} bytes are over the bound of {most}"
    try:
        with fs.open_input_stream(path) as f:
            return fold(f.read()), None
    except (OSError, pa.ArrowException) as e:
        return None, f"{type(e).__name__}: {e}"


def _open(uri: str):
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


@dataclass
class Files(InputPartition):
    rows: list[tuple]        # path, repo, rel_path, size, uri, read_error

    def __init__(self, rows: list[tuple]):
        super().__init__(None)
        self.rows = rows


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        own = {k.lower(): v for k, v in options.items()}
        self.root = own["root"].rstrip("/")
        self.content = str(own.get("content", "true")).lower() == "true"
        self.partition_bytes = int(own.get("maxpartitionbytes", MAX_PARTITION_BYTES))
        self.file_bytes = int(own.get("maxfilebytes", MAX_FILE_BYTES))
        self.prefixes: list[str] = []
        self.sizes: list[tuple[str, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, value = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, getattr(f, "value", None)
            if isinstance(f, (EqualTo, StringStartsWith)) and name == "path":
                self.prefixes.append(value if isinstance(f, StringStartsWith) else value + "\0")
                if isinstance(f, StringStartsWith):
                    continue
            elif isinstance(f, EqualTo) and name == "repo":
                self.prefixes.append(f"{os.path.basename(self.root)}/{value}/")
            elif name == "size_bytes" and isinstance(f, (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)):
                self.sizes.append((type(f).__name__, value))
                continue
            elif isinstance(f, In) and name == "repo":
                self.repos = {f"{os.path.basename(self.root)}/{v}/" for v in f.value}
            yield f                          # also those only used to list less

    def _wanted_folder(self, path: str) -> bool:
        """Whether files below a folder (path with / at its end) can be wanted."""
        at = path.count("/")
        repos = getattr(self, "repos", None)
        if repos is not None and at >= 2 and "/".join(path.split("/")[:2]) + "/" not in repos:
            return False
        return all(p.rstrip("\0").startswith(path) or path.startswith(p.rstrip("\0")) for p in self.prefixes)

    def _wanted_file(self, path: str, size: int) -> bool:
        for p in self.prefixes:
            if not (path == p[:-1] if p.endswith("\0") else path.startswith(p)):
                return False
        test = {"LessThan": size.__lt__, "LessThanOrEqual": size.__le__, "GreaterThan": size.__gt__, "GreaterThanOrEqual": size.__ge__}
        return all(test[op](v) for op, v in self.sizes)

    def _list(self) -> Iterator[tuple]:
        from pyarrow.fs import FileSelector, FileType
        fs, top = _open(self.root)
        if fs.get_file_info(top).type != FileType.Directory:
            return                           # a missing root is skipped
        base = os.path.basename(self.root)
        todo = [(top, base + "/", 0)]
        while todo:
            folder, path, depth = todo.pop()
            try:
                if depth > DEEPEST:
                    raise OSError(f"more than {DEEPEST} folders below one another")
                infos = sorted(fs.get_file_info(FileSelector(folder)), key=lambda i: i.base_name)
            except (OSError, pa.ArrowException) as e:
                yield self._row(path.rstrip("/"), 0, folder, f"{type(e).__name__}: {e}")
                continue
            if fs.type_name == "local":      # links that lead nowhere are files that can't be read
                for name in sorted({*os.listdir(folder)}.difference(i.base_name for i in infos)):
                    if depth and self._wanted_file(path + name, 0):
                        yield self._row(path + name, 0, f"{folder}/{name}", "the link leads nowhere")
            for i in infos:
                own = path + i.base_name
                if i.type == FileType.Directory:
                    # links to folders are not followed
                    if self._wanted_folder(own + "/") and not (fs.type_name == "local" and os.path.islink(i.path)):
                        todo.append((i.path, own + "/", depth + 1))
                elif depth and self._wanted_file(own, i.size or 0):        # files beside the repositories belong to none
                    yield self._row(own, i.size or 0, i.path, None if i.type == FileType.File else "neither a file nor a folder")

    @staticmethod
    def _row(path: str, size: int, where: str, error: str | None) -> tuple:
        parts = path.split("/", 2)
        return path, parts[1] if len(parts) > 1 else "", parts[2] if len(parts) > 2 else "", size, where, error

    def partitions(self) -> list[Files]:
        out, rows, total = [], [], 0
        for r in self._list():
            if rows and total + r[3] > self.partition_bytes:
                out.append(Files(rows))
                rows, total = [], 0
            rows.append(r)
            total += r[3]
        return [*out, Files(rows)] if rows else out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.root)
        names = ["path", "repo", "rel_path", "size_bytes", "uri", "read_error"] + (["content"] if self.content else [])
        kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string()] + ([pa.string()] if self.content else [])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for path, repo, rel, size, where, error in partition.rows:
            text = None
            if self.content and error is None:
                text, error = read_text(fs, where, size, self.file_bytes)
            rows.append((path, repo, rel, size, where, error) + ((text,) if self.content else ()))
            held += size
            if held >= BATCH_BYTES or len(rows) >= 4096:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTING + (", content string" if str(self.options.get("content", "true")).lower() == "true" else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def _load(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("source_tree").option("root", root)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def list_tree(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """Every file below the roots, scanned or not, without its text."""
    out = _load(spark, roots[0], content="false", **options)
    for r in roots[1:]:
        out = out.unionByName(_load(spark, r, content="false", **options))
    return out


def scan_tree(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """S1-S3 as ``files``: scanned files of every repository below the roots;
    what can't be read is a row with ``read_error``."""
    out = _load(spark, roots[0], **options)
    for r in roots[1:]:
        out = out.unionByName(_load(spark, r, **options))
    keep = TX.is_scanned("path") | F.col("read_error").isNotNull()
    return finish_read(out.filter(keep))


def finish_read(rows: DataFrame) -> DataFrame:
    """The derived columns of ``files`` beside a size and an error that are known."""
    return (rows.withColumn("ext", F.regexp_replace(TX.suffix("path"), r"^\.", ""))
            .withColumn("language", TX.detect_language("path")).withColumn("line_count", TX.line_count("content"))
            .withColumn("size_bytes", F.coalesce(TX.size_bytes("content"), "size_bytes"))
            .withColumn("sha", F.sha2("content", 256)).select(*FILES_COLUMNS))


def read_listed(listing: DataFrame, root: str, most: int = MAX_FILE_BYTES) -> DataFrame:
    """``listing`` rows with their text, read in the tasks that hold them."""
    cols = listing.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(root)
        for b in it:
            for row in b.to_pylist():        # one text at a time in memory
                text, error = (None, row["read_error"]) if row["read_error"] else read_text(fs, row["uri"], row["size_bytes"], most)
                one = pa.RecordBatch.from_pylist([{**row, "read_error": error}], schema=b.schema)
                yield one.append_column("content", pa.array([text], pa.string()))
    return listing.mapInArrow(batches, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema) + ", content string").select(*cols, "content")

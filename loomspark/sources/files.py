"""Source trees as a Spark data source: files are listed once, and only those that a read asks for are opened, by the tasks.

`spark.read.format("source_tree")` takes the options path (a folder, a file or an archive), skip_dirs (names of folders,
joined by commas), skip_pattern (a regular expression for the path below the root), extensions (joined by commas) and
files_per_task. Filters on path and name are taken over from the query where Spark hands them on
(spark.sql.python.filterPushdown.enabled). Archives (zip, tar, also compressed) are read member by member in one
task; nothing is unpacked to a disk. Any store that pyarrow opens will do; what is no UTF-8 is left out.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from loomspark.functions.names import language

ARCHIVES = (".zip", ".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz")
TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda x, v: v in x}


class Files(InputPartition):
    """Files of one task: places in the store and paths below the root; of an archive the members are listed in the task."""

    def __init__(self, root: str, found: list[tuple[str, str]], archive: bool):
        super().__init__(0)
        self.root, self.found, self.archive = root, found, archive


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.skip_dirs = [d for d in options.get("skip_dirs", "").split(",") if d]
        self.skip_pattern = options.get("skip_pattern")
        self.extensions = [e.lower() for e in options.get("extensions", "").split(",") if e]
        self.at_once = int(options.get("files_per_task", 500))
        self.tests: list[tuple[str, type, object]] = []

    def wanted(self, path: str) -> bool:
        name = path.rpartition("/")[2]
        folders = path.split("/")[:-1]
        return (
            not any(d in folders for d in self.skip_dirs)
            and not (self.skip_pattern and re.search(self.skip_pattern, path))
            and (not self.extensions or name.rpartition(".")[2].lower() in self.extensions)
            and all(TESTS[kind](path if column == "path" else name, value) for column, kind, value in self.tests)
        )

    def partitions(self) -> list[Files]:
        store, base = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        here = store.get_file_info(base)
        if here.type == fs.FileType.NotFound:
            raise ValueError(f"no such file or folder: {self.root}")
        if here.type == fs.FileType.File:
            return [Files(self.root, [(base, base.rpartition("/")[2])], base.lower().endswith(ARCHIVES))]
        base = base.rstrip("/")
        listed = store.get_file_info(fs.FileSelector(base, recursive=True))
        found = sorted((x.path, x.path[len(base) + 1 :]) for x in listed if x.type == fs.FileType.File)
        found = [x for x in found if self.wanted(x[1])]
        return [Files(self.root, found[i : i + self.at_once], False) for i in range(0, len(found), self.at_once)] or [Files(self.root, [], False)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store = fs.FileSystem.from_uri(partition.root)[0] if "://" in partition.root else fs.LocalFileSystem()
        for place, path in partition.found:
            with store.open_input_file(place) as file:
                held = self._members(file.readall() if place.lower().endswith(".zip") else file, place) if partition.archive else [(path, file.readall())]
                for name, data in held:
                    try:
                        yield name, name.rpartition("/")[2], data.decode()
                    except UnicodeDecodeError:
                        continue

    def _members(self, file, place: str) -> Iterator[tuple[str, bytes]]:
        if place.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(file)) as z:
                for info in z.infolist():
                    if not info.is_dir() and self.wanted(info.filename):
                        yield info.filename, z.read(info)
            return
        with tarfile.open(fileobj=file, mode="r|*") as t:
            for member in t:
                name = member.name.removeprefix("./")
                if member.isfile() and self.wanted(name):
                    yield name, t.extractfile(member).read()


class FilteringTreeReader(TreeReader):
    """A reader that takes filters over; Spark refuses it where it hands none on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (the name that Spark calls)
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if type(f) in TESTS and column in (("path",), ("name",)):
                self.tests.append((column[0], type(f), f.value))
            else:
                yield f


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, name string, content string"

    def reader(self, schema) -> TreeReader:
        return (FilteringTreeReader if self.options.get("push_filters") == "true" else TreeReader)(self.options)


def read_source_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """(path, name, language, content) of the files of a folder or archive."""
    spark.dataSource.register(SourceTree)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    rows = spark.read.format("source_tree").options(path=root, push_filters=push, **options).load()
    return rows.select("path", "name", language(F.col("path")).alias("language"), "content")


def write_source_tree(files: DataFrame, root: str) -> int:
    """Writes files(path, content) below root, each by the task that holds it; how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                at = f"{base.rstrip('/')}/{path}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write((content or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

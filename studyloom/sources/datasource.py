"""The store as a Python data source: spark.read.format("studyloom").option("table", "reports").load(root).

Reading takes one version of the store (option `version`, else the newest); filters on study_id and trial_id reach the
Parquet files. As a stream, versions are the offsets: each micro-batch has what the commits since the last one have appended, and
compactions, which hold old rows anew, are passed over. Writing appends: each task writes a file, and one commit names
them all; if a task fails for good, the files go.
Files are opened by the workers, so `root` is a path or URI that Arrow can read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import ARTIFACTS, REPORTS, STUDIES, StorageError

NAME = "studyloom"
#: Columns whose equality is pushed down.
PUSHED = ("study_id", "trial_id")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)


class Files:
    """The store's files as Arrow sees them."""

    def __init__(self, root: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        self.root = self.root.rstrip("/")

    def versions(self) -> list[int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/_manifest", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def at(self, version: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/_manifest/{version:08d}.json") as f:
            return json.loads(f.read())

    def parquet_files(self, folders: list[str]) -> list[str]:
        from pyarrow import fs

        return sorted(f.path for folder in folders for f in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}")) if f.base_name.endswith(".parquet"))

    def commit(self, table: str, folder: str) -> int:
        """A version more, in which the table has this folder too."""
        versions = self.versions()
        if not versions:
            raise StorageError("there is no store here; open one first")
        own = self.at(versions[-1])
        own["tables"].setdefault(table, []).append(folder)
        draft, final = f"{self.root}/_manifest/{uuid.uuid4().hex}.draft", f"{self.root}/_manifest/{versions[-1] + 1:08d}.json"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(own | {"kind": "append"}, sort_keys=True).encode())
        try:
            if self.fs.type_name == "local":
                import os

                os.link(draft, final)  # fails if the version exists
            else:
                from pyarrow import fs

                if self.fs.get_file_info(final).type != fs.FileType.NotFound:
                    raise FileExistsError(final)
                self.fs.copy_file(draft, final)
        except FileExistsError as taken:
            raise StorageError(f"version {versions[-1] + 1} was written by someone else") from taken
        finally:
            self.fs.delete_file(draft)
        return versions[-1] + 1


def schema_of(table: str) -> StructType:
    from .store import EVENTS

    try:
        return {"studies": STUDIES, "trials": EVENTS, "reports": REPORTS, "artifacts": ARTIFACTS}[table]
    except KeyError:
        raise StorageError(f"no such table: {table}") from None


@dataclass
class FilePartition(InputPartition):
    path: str


def read_file(files: Files, path: str, schema: StructType, equal: dict[str, int]) -> Iterator:
    """Record batches of a file's rows that pass the filters, with columns it lacks as nulls."""
    import pyarrow as pa
    import pyarrow.dataset as ds
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    found = ds.dataset(path, format="parquet", filesystem=files.fs, schema=arrow)
    where = None
    for column, value in equal.items():
        one = ds.field(column) == pa.scalar(value)
        where = one if where is None else where & one
    yield from found.to_batches(filter=where)


class StoreReader(DataSourceReader):
    def __init__(self, root: str, table: str, schema: StructType, version: int | None) -> None:
        self.root, self.table, self.schema, self.version = root, table, schema, version
        self.equal: dict[str, int] = {}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in [(c,) for c in PUSHED] and f.attribute[0] in self.schema.fieldNames() and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[FilePartition]:
        files = Files(self.root)
        versions = files.versions()
        if not versions:
            return []
        own = files.at(versions[-1] if self.version is None else self.version)
        return [FilePartition(p) for p in files.parquet_files(own["tables"].get(self.table, []))]

    def read(self, partition: FilePartition) -> Iterator:
        yield from read_file(Files(self.root), partition.path, self.schema, self.equal)


class StoreStream(DataSourceStreamReader):
    def __init__(self, root: str, table: str, schema: StructType) -> None:
        self.root, self.table, self.schema = root, table, schema

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": max(Files(self.root).versions(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        files = Files(self.root)
        kept = [v for v in files.versions() if v <= end["version"]]
        seen = set(files.at(start["version"])["tables"].get(self.table, [])) if start["version"] in kept else set()
        new: list[str] = []
        for v in [v for v in kept if v > start["version"]]:
            own = files.at(v)
            folders = own["tables"].get(self.table, [])
            # The oldest version that is left stands for all before it.
            if own.get("kind") != "replace" or (v == kept[0] and not seen):
                new += [f for f in folders if f not in seen]
            seen.update(folders)
        return [FilePartition(p) for p in files.parquet_files(new)]

    def read(self, partition: FilePartition) -> Iterator:
        yield from read_file(Files(self.root), partition.path, self.schema, {})

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, root: str, table: str, schema: StructType) -> None:
        self.root, self.table, self.schema = root, table, schema
        self.folder = f"data/{table}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        files, arrow, writer = Files(self.root), to_arrow_schema(self.schema), None
        path = f"{files.root}/{self.folder}/part-{uuid.uuid4().hex}.parquet"
        for batch in iterator:
            if writer is None:
                files.fs.create_dir(f"{files.root}/{self.folder}")
                writer = pq.ParquetWriter(path, arrow, filesystem=files.fs)
            writer.write_batch(batch.cast(arrow))
        if writer is None:
            return Written(None)
        writer.close()
        return Written(path)

    def commit(self, messages: list) -> None:
        """Names the files of the tasks that succeeded; what other attempts have left goes."""
        files, kept = Files(self.root), {m.path for m in messages if m is not None and m.path}
        if kept:
            for p in set(files.parquet_files([self.folder])) - kept:
                files.fs.delete_file(p)
            files.commit(self.table, self.folder)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        files = Files(self.root)
        if files.fs.get_file_info(f"{files.root}/{self.folder}").type == fs.FileType.Directory:
            files.fs.delete_dir(f"{files.root}/{self.folder}")


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _of(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("table", "reports")

    def schema(self) -> StructType:
        return schema_of(self._of()[1])

    def reader(self, schema: StructType) -> StoreReader:
        version = self.options.get("version")
        return StoreReader(*self._of(), schema, None if version is None else int(version))

    def streamReader(self, schema: StructType) -> StoreStream:
        return StoreStream(*self._of(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        if overwrite:
            raise StorageError("a history is appended to, not replaced")
        return StoreWriter(*self._of(), schema)

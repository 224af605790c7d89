"""Folders of nested documents as a Spark data source: spark.read.format("documents") and df.write.format("documents").

    register(spark)
    spark.read.format("documents").load("/data/families")          # file, value (JSON), reason
    rows.write.format("documents").mode("append").save("/data/out")  # name, value

Reading: every .yml, .yaml and .json file of a folder (or one file, with or
without its suffix; option `names` restricts a folder to some, separated by
commas) becomes a row: its document as JSON text, or why it has none. A file
that can't be decoded or parsed, or isn't one mapping, is a row with a reason;
a file that can't be read at all is an error of the store, which Spark retries.
Small files share a partition of up to `partitionBytes`. Filters on `file` (=,
IN) reach the listing.

Writing: a task writes its documents under names of its own; the commit moves
them all into place, an abort deletes them, so what is seen is all of a write or
(until the moves begin) nothing. Mode append refuses documents that exist, and
two rows of one name in any mode; overwrite replaces the documents it writes.
Documents go from tasks to files: the driver sees names only. With option `raw`
values are texts that are written as they are.

Folders are reached by every task through Arrow's file systems (local or mounted
paths, and file://, hdfs://, s3:// where Arrow has them).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SUFFIXES = (".yml", ".yaml", ".json")
PARTITION_BYTES, OPEN_BYTES = 8 << 20, 64 << 10
STAGING = "_writing-"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _base(path: str) -> str:
    """The document's name: the file's without its suffix."""
    name = path.rsplit("/", 1)[-1]
    return unquote(next((name.removesuffix(s) for s in SUFFIXES if name.endswith(s)), name))


def parsed(data: bytes, yaml_text: bool) -> tuple[str | None, str | None]:
    """(JSON text, None), or (None, why there is none)."""
    import yaml

    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        return None, f"not UTF-8 at byte {e.start}"
    try:
        found = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if yaml_text else json.loads(text)
    except yaml.MarkedYAMLError as e:
        at = e.problem_mark or e.context_mark
        return None, f"malformed at line {at.line + 1}" if at else "malformed"
    except json.JSONDecodeError as e:
        return None, f"malformed at line {e.lineno}"
    except (yaml.YAMLError, RecursionError, ValueError):
        return None, "malformed"
    if not isinstance(found, dict):
        return None, "not a mapping"
    try:
        return json.dumps(found, default=str, ensure_ascii=False), None
    except (TypeError, ValueError, RecursionError):
        return None, "keys or values that JSON has not"


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"].rstrip("/"), int(options.get("partitionBytes", PARTITION_BYTES))
        self.names = {x.strip() for x in options["names"].split(",")} if "names" in options else None
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                values = set(f.value if isinstance(f, In) else (f.value,))
                self.only = values if self.only is None else self.only & values
            else:
                yield f

    def _listed(self):
        from pyarrow import fs

        store, path = _opened(self.path)
        here = store.get_file_info(path)
        if here.type == fs.FileType.Directory:
            return [x for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.path.endswith(SUFFIXES) and not x.base_name.startswith(("_", "."))]
        found = [x for x in ([here] + [store.get_file_info(path + s) for s in SUFFIXES]) if x.type == fs.FileType.File]
        if not found:
            raise FileNotFoundError(f"{self.path}: no folder and no document")
        return found[:1]

    def partitions(self) -> list[_Files]:
        groups: list[list[str]] = []
        room = 0
        for x in sorted(self._listed(), key=lambda x: x.path):
            name = _base(x.path)
            if (self.names is not None and name not in self.names) or (self.only is not None and name not in self.only):
                continue
            size = x.size + OPEN_BYTES
            if not groups or size > room:
                groups.append([])
                room = self.bytes
            groups[-1].append(x.path)
            room -= size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                value, reason = parsed(f.readall(), not path.endswith(".json"))
            yield _base(path), value, reason


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.raw = options["path"].rstrip("/"), overwrite, options.get("raw", "false").lower() == "true"
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def _text(self, value: str) -> str:
        if self.raw:
            return value
        import yaml

        return yaml.dump(json.loads(value), Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), default_flow_style=False, sort_keys=False, allow_unicode=True)

    def write(self, iterator) -> _Staged:
        store, path = _opened(self.path)
        folder, names = f"{path}/{self.staging}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for row in iterator:
            if row["name"] is None or row["value"] is None:
                raise ValueError("a document has a name and a value")
            file = f"{quote(row['name'], safe=' +#')}.yml"
            if file in names[-1:] or file.startswith(("_", ".")):
                raise ValueError(f"{row['name']}: two documents of one name, or a name that begins with _ or a dot")
            with store.open_output_stream(f"{folder}/{file}") as f:
                f.write(self._text(row["value"]).encode())
            names.append(file)
        return _Staged(folder, names)

    def commit(self, messages: list[_Staged | None]) -> None:
        from pyarrow import fs

        store, path = _opened(self.path)
        staged = [m for m in messages if m is not None]
        names = [n for m in staged for n in m.names]
        there = {x.base_name for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True))}
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        taken = [] if self.overwrite else sorted(there & set(names))
        if twice or taken:
            self.abort(messages)
            raise ValueError(f"documents {'of one name' if twice else 'that exist'}: {', '.join(map(_base, (twice or taken)[:20]))}")
        for m in staged:
            for n in m.names:
                store.move(f"{m.folder}/{n}", f"{path}/{n}")
        self._clear()

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, path = _opened(self.path)
        if store.get_file_info(f"{path}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.staging}")


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "file string, value string, reason string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"name", "value"} - set(schema.names)
        if missing:
            raise ValueError(f"documents are written from columns name and value; missing: {', '.join(sorted(missing))}")
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)


def read_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """file, value, reason of a folder's documents, or of one."""
    register(spark)
    return spark.read.format("documents").options(**options).load(path)


def write_files(docs: DataFrame, path: str, name: str = "name", overwrite: bool = False) -> None:
    """A YAML file a document, keys in the columns' order, nulls written."""
    register(docs.sparkSession)
    rows = docs.select(F.col(name).cast("string").alias("name"), F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.format("documents").mode("overwrite" if overwrite else "append").save(path)

"""A folder of signed documents as a Spark data source: ``spark.read.format("signed_documents").load(folder)``.

Working copies lie in the folder, older copies in its archive folder.  Files are dealt over partitions and read by the tasks; equality filters
on the listed columns are pushed into the reader, where one on ``archived`` leaves a whole folder unread.

Options: ``archive`` (subfolder, default history), ``suffix`` (default .json), ``lines`` (true: each line of a file is a document),
``files_per_task`` (default 64).  Folders are local or of any store that Arrow's file systems reach.

Defined results: unreadable files, texts that are no JSON object, and documents without an identity that names an id, a model, a version and a time are
skipped; empty files and empty or missing folders give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "passport_id string, model_name string, version string, created_at string, verdict string, sequence int, archived boolean, path string, document string"
SCHEMA_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
PUSHED = ("passport_id", "model_name", "version", "verdict", "sequence", "archived")


class Files(InputPartition):
    def __init__(self, paths: list[str], archived: bool) -> None:
        super().__init__((paths, archived))


def entry_of(text: str, archived: bool, path: str) -> tuple | None:
    """The row of a document's text, or None where it is none."""
    try:
        document = json.loads(text)
        identity = document["identity"]
        named = [identity[k] for k in ("passport_id", "model_name", "version", "created_at")]
        verdict, sequence = (document.get("policy") or {}).get("verdict"), (document.get("revision") or {}).get("sequence")
    except (AttributeError, KeyError, TypeError, ValueError):
        return None
    if not all(isinstance(v, str) for v in named) or not isinstance(verdict, str | None) or not isinstance(sequence, int | None):
        return None
    return (*named, verdict, sequence, archived, path, text)


class DirectoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.archive = options["path"], options.get("archive", "history")
        self.suffix, self.lines = options.get("suffix", ".json"), options.get("lines", "false").lower() == "true"
        self.per_task = int(options.get("files_per_task", "64"))
        self.wanted: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in PUSHED and self.wanted.get(f.attribute[0], f.value) == f.value:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if self.root.startswith("file:") or "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        store, root = self._store()
        out: list[InputPartition] = []
        for archived, folder in ((False, root), (True, f"{root}/{self.archive}")):
            if self.wanted.get("archived", archived) == archived:
                found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                paths = sorted(i.path for i in found if i.is_file and i.base_name.endswith(self.suffix) and not i.base_name.startswith((".", "_")))
                out += [Files(paths[at : at + self.per_task], archived) for at in range(0, len(paths), self.per_task)]
        return out or [Files([], False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        paths, archived = partition.value
        store, _ = self._store()
        at = [SCHEMA_NAMES.index(c) for c in self.wanted]
        for path in paths:
            try:
                with store.open_input_stream(path) as stream:
                    text = stream.read().decode()
            except (OSError, UnicodeDecodeError):
                continue
            for one in text.splitlines() if self.lines else [text]:
                row = entry_of(one, archived, path)
                if row and all(row[i] == v for i, v in zip(at, self.wanted.values(), strict=True)):
                    yield row


class SignedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signed_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return DirectoryReader(dict(self.options))


def read_directory(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Every readable document of a folder and its archive."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SignedDocuments)
    return spark.read.format("signed_documents").options(**options).load(folder)


def working_copies(documents: DataFrame) -> DataFrame:
    """One row for each id: the working copy before archived ones, then the one with the smallest path and text.

    Filters on other columns than the id belong behind this, so that none brings an older copy to light.
    """
    first = F.min_by(F.struct(*documents.columns), F.struct("archived", "path", "document")).alias("row")
    return documents.groupBy("passport_id").agg(first).select("row.*")

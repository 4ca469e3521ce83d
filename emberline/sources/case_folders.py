"""A writer of case folders: for each row a folder with case.json and the files that go with it.

Tasks write below a staging folder, each into one of its own; when all have ended well, the driver moves every task's folder to its place, one
move a task. If a task fails, nothing appears, and what was staged is removed.

    spark.dataSource.register(CaseFolders)
    folder_rows(cases, texts).write.format("case_folders").mode("append").save(path)
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

ROW = "case_id string, case_json string, files map<string,string>"


def folder_rows(cases: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(case_id, case_json, files) of cases, with the texts of files(case_id, name, text); a name within a case has one text.

    case_json tells nulls, has line feeds and two spaces a level. Columns that a loader adds (folder) are left out.
    """
    columns = [c for c in cases.columns if c != "folder"]
    json = F.to_json(F.struct(*columns), {"pretty": "true", "ignoreNullFields": "false"})
    rows = cases.select("case_id", F.concat(json, F.lit("\n")).alias("case_json"))
    if files is None:
        return rows.withColumn("files", F.create_map().cast("map<string,string>"))
    held = files.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("files"))
    return rows.join(held, "case_id", "left").withColumn("files", F.coalesce("files", F.create_map().cast("map<string,string>")))


def safe_name(name: str) -> str:
    """name, if it stays within its folder; else ValueError."""
    parts = name.replace("\\", "/").split("/")
    if not name or name.startswith("/") or ":" in parts[0] or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"{name!r} is no path within a case folder")
    return "/".join(parts)


@dataclass
class Written(WriterCommitMessage):
    task: int
    n_cases: int
    folder: str


class CaseFolders(DataSource):
    """The format case_folders, for writing only."""

    @classmethod
    def name(cls) -> str:
        return "case_folders"

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        if [f.name for f in schema.fields] != ["case_id", "case_json", "files"]:
            raise ValueError(f"case folders are written from {ROW}")
        if overwrite:
            raise ValueError("case folders are only appended; write to a new path")
        return FolderWriter(self.options["path"])


class FolderWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.job = uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.job}"

    def _store(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else os.path.abspath(path))

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = self._store(f"{self.staging}/{task.partitionId():05d}-{task.taskAttemptId()}")
        n = 0
        for row in iterator:
            folder = f"{root}/{safe_name(row.case_id)}"
            if "/" in safe_name(row.case_id):
                raise ValueError(f"{row.case_id!r} is no case id")
            for name, text in [("case.json", row.case_json), *((row.files or {}).items())]:
                file = f"{folder}/{safe_name(name)}"
                store.create_dir(file.rpartition("/")[0], recursive=True)
                with store.open_output_stream(file, compression=None) as out:
                    out.write((text or "").encode())
            n += 1
        return Written(task.partitionId(), n, root)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.n_cases:
                store, target = self._store(f"{self.path}/part-{m.task:05d}-{self.job[:12]}")
                store.move(m.folder, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        # Tasks that Spark hasn't stopped yet may still write; what they leave has a name that readers pass over.
        for _ in range(5):
            try:
                return self._clear()
            except OSError:
                time.sleep(1)

    def _clear(self) -> None:
        from pyarrow import fs

        store, place = self._store(self.staging)
        if store.get_file_info(place).type == fs.FileType.Directory:
            store.delete_dir(place)


def write_folders(rows: DataFrame, path: str) -> None:
    """folder_rows() as folders below path."""
    rows.sparkSession.dataSource.register(CaseFolders)
    rows.select("case_id", "case_json", "files").write.format("case_folders").mode("append").save(path)

"""Reports as lines of text with an exit code: a Python data source to write to.

``spark.dataSource.register(ReportSink)``, then ``df.write.format("panel_report").mode("append").option("path", ...).save()`` for
rows of ``line`` and ``code``. Each task writes a file of its own under a name that no reader takes for output; only when all
have ended are the files named, and the status with the number of lines and the exit code (the largest code of any
line, 0 without one) is written last. Where a task fails there is no output, and the files of the others are removed. Folders are those of ``pyarrow.fs``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STATUS = "_STATUS.json"


@dataclass
class Written(WriterCommitMessage):
    name: str
    lines: int
    code: int


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def folder(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        return system, path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, path = self.folder()
        system.create_dir(path, recursive=True)
        name, lines, code = f"_task-{self.job}-{uuid.uuid4().hex}", 0, 0
        try:
            with system.open_output_stream(f"{path}/{name}") as out:
                for row in iterator:
                    out.write(f"{row['line']}\n".encode())
                    lines, code = lines + 1, max(code, row["code"] or 0)
        except BaseException:
            system.delete_file(f"{path}/{name}")
            raise
        return Written(name, lines, code)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = self.folder()
        done = [m for m in messages if m is not None]
        for k, m in enumerate(done):
            if m.lines:
                system.move(f"{path}/{m.name}", f"{path}/part-{k:05d}.txt")
        self.clear()
        with system.open_output_stream(f"{path}/{STATUS}") as out:
            out.write(json.dumps({"exit_code": max((m.code for m in done), default=0), "lines": sum(m.lines for m in done)}, sort_keys=True).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        """What tasks of this job have left: of attempts that failed, or came second."""
        from pyarrow import fs

        system, path = self.folder()
        for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if i.base_name.startswith(f"_task-{self.job}-"):
                system.delete_file(i.path)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "panel_report"

    def schema(self) -> str:
        return "line string, code int"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if not self.options.get("path"):
            raise ValueError("a report needs a path")
        return ReportWriter(self.options["path"])


def write_report(lines: DataFrame, path: str) -> int:
    """Writes ``line`` and ``code`` below ``path``, a folder that doesn't exist yet; returns the exit code."""
    spark = lines.sparkSession
    spark.dataSource.register(ReportSink)
    lines.select("line", F.col("code").cast("int").alias("code")).write.format("panel_report").mode("append").option("path", path).save()
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path)
    with system.open_input_file(f"{folder.rstrip('/')}/{STATUS}") as f:
        return json.loads(f.read())["exit_code"]

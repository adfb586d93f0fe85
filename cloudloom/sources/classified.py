"""Classified clouds as a sink: one pass writes all files, whole or by macro group, or none.

Tasks write where they run, into a folder of the job; their messages list what is
complete. The commit moves those files to their names, so a task that died, ran twice or lost a race
leaves nothing; an abort removes the job's folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import formats

FILE_ROWS = 4_000_000  # of one written file, about: what a task holds for each folder
COLUMNS = ("x", "y", "z", "r", "g", "b", "label", "macro_group")


@dataclass
class Written(WriterCommitMessage):
    """(temporary name, folder below the target, name, rows) of each complete file of a task."""

    files: list[tuple[str, str, str, int]] = field(default_factory=list)


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.kind, self.job = options["path"].rstrip("/"), options["kind"], options["job"]
        self.routes = {"whole": ("",), "groups": ("group",), "both": ("", "group")}[options.get("routes", "whole")]
        self.rows, self.overwrite = int(options.get("filerows", FILE_ROWS)), overwrite

    def _own(self, base: str) -> str:
        return f"{base}/.writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = _files(self.folder)
        own = self._own(base)
        files.create_dir(own, recursive=True)
        held: dict[str, list[pa.RecordBatch]] = {}
        count: dict[str, int] = {}
        done = Written()

        def flush(where: str) -> None:
            cols = [pa.chunked_array([b.column(i) for b in held[where]]).to_numpy() for i in range(7)]
            data = (formats.classified_ply if self.kind == "ply" else formats.las_file)(*cols)
            name = f"part-{self.job}-{task.partitionId():05d}-{sum(f[1] == where for f in done.files):04d}.{self.kind}"
            mine = f"{own}/{task.taskAttemptId()}-{len(done.files)}"
            with files.open_output_stream(mine) as out:
                out.write(data)
            done.files.append((mine, where, name, len(cols[0])))
            held[where], count[where] = [], 0

        for batch in iterator:
            for route in self.routes:
                groups = batch.column(7).to_numpy(zero_copy_only=False) if route else np.array([""] * batch.num_rows)
                for where in sorted(set(groups.tolist())):
                    some = batch.filter(pa.array(groups == where))
                    held.setdefault(where, []).append(some)
                    count[where] = count.get(where, 0) + some.num_rows
                    if count[where] >= self.rows:
                        flush(where)
        for where in [w for w, n in count.items() if n]:
            flush(where)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Files take their names; those of a job of the same name, and with overwrite all of the folder's, go first."""
        from pyarrow import fs

        files, base = _files(self.folder)
        files.create_dir(base, recursive=True)
        for old in files.get_file_info(fs.FileSelector(base, recursive=True)):
            name = old.path.rpartition("/")[2]
            hidden = "/.writing-" in old.path
            if old.type == fs.FileType.File and not hidden and name.endswith(f".{self.kind}") and (self.overwrite or name.startswith(f"part-{self.job}-")):
                files.delete_file(old.path)
        listed = []
        for m in messages:
            for mine, where, name, n in m.files if m else ():
                files.create_dir(f"{base}/{where}".rstrip("/"), recursive=True)
                files.move(mine, f"{base}/{where}/{name}".replace("//", "/"))
                listed.append([f"{self.folder}/{where}/{name}".replace(f"{self.folder}//", f"{self.folder}/"), where, n])
        with files.open_output_stream(f"{base}/_files-{self.job}.json") as out:
            out.write(json.dumps(sorted(listed)).encode())
        self._clear(files, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_files(self.folder))

    def _clear(self, files, base: str) -> None:
        from pyarrow import fs

        if files.get_file_info(self._own(base)).type == fs.FileType.Directory:
            files.delete_dir(self._own(base))


class ClassifiedFiles(DataSource):
    """``df.write.format("classifiedfiles")`` with the options path, kind (ply or las), job, routes (whole, groups or both) and fileRows."""

    @classmethod
    def name(cls) -> str:
        return "classifiedfiles"

    def schema(self) -> str:
        return "x double, y double, z double, r smallint, g smallint, b smallint, label smallint, macro_group string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def save(rows: DataFrame, folder: str, kind: str, job: str, routes: str = "whole", file_rows: int = FILE_ROWS, overwrite: bool = False) -> list[tuple[str, str, int]]:
    """Write ``rows`` (x, y, z, r, g, b, label, macro_group); (path, group or empty, rows) of each file. ``folder`` is a whole URI."""
    spark = rows.sparkSession
    if kind not in ("ply", "las"):
        raise ValueError(f"unknown kind {kind!r}; known are las, ply")
    spark.dataSource.register(ClassifiedFiles)
    out = rows.select(*COLUMNS).write.format("classifiedfiles").mode("overwrite" if overwrite else "append")
    out.option("path", folder).option("kind", kind).option("job", job).option("routes", routes).option("fileRows", file_rows).save()
    files, base = _files(folder)
    with files.open_input_file(f"{base}/_files-{job}.json") as f:
        return [tuple(x) for x in json.loads(f.read())]

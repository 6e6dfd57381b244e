"""Tar archives: members as rows, streamed one after another."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

BATCH_BYTES = 16 << 20


def _open(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root)


def write_tars(members: DataFrame, root: str) -> DataFrame:
    """One compressed archive per partition of ``members`` (name, content); ``path`` of each, one row per archive.

    An archive is named after the attempt that wrote it, so a repeated task leaves an unused file at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, archive = TaskContext.get(), None
        fs, folder = _open(root)
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tar.gz"
        for batch in batches:
            if archive is None:
                fs.create_dir(folder)
                out = fs.open_output_stream(path, compression=None)
                archive = tarfile.open(fileobj=out, mode="w|gz")
            for name, content in zip(batch["name"], batch["content"], strict=True):
                member = tarfile.TarInfo(name)
                member.size = len(content)
                archive.addfile(member, io.BytesIO(content))
        if archive is not None:
            archive.close()
            out.close()
            yield pd.DataFrame({"path": [path.removeprefix(folder + "/")]})

    return members.select("name", "content").mapInPandas(run, "path string")


def read_tars(archives: DataFrame, root: str, suffix: str = "") -> DataFrame:
    """``path, name, content`` of the files in the archives (path) whose names end in ``suffix``.

    A task reads an archive as a stream and holds one batch of members, whatever the archive's size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = _open(root)
        for path in (p for batch in batches for p in batch["path"]):
            with fs.open_input_stream(f"{folder}/{path}", compression=None) as source, tarfile.open(fileobj=source, mode="r|*") as archive:
                held, size = [], 0
                for member in archive:
                    if member.isfile() and member.name.endswith(suffix):
                        held.append((path, member.name, archive.extractfile(member).read()))
                        size += member.size
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(held, columns=["path", "name", "content"])
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["path", "name", "content"])

    return archives.select("path").mapInPandas(run, "path string, name string, content binary")

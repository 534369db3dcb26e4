"""Files that tasks write and read themselves, under a folder all executors share.

A task writes to names of its own (task and attempt), and only names that reach the materialised manifest count, so a lost or
repeated task leaves at most a file nobody reads.
"""

from __future__ import annotations

import uuid

from pyarrow import fs

from .shared import file_uri


def open_read(uri: str):
    system, path = fs.FileSystem.from_uri(file_uri(uri))
    return system.open_input_file(path)


def open_stream(uri: str):
    system, path = fs.FileSystem.from_uri(file_uri(uri))
    return system.open_input_stream(path, compression=None)


class Parts:
    """Writes items one after the other into files of about ``most`` bytes: part-<task>-<unique>-<n><suffix>."""

    def __init__(self, folder: str, suffix: str, most: int):
        from pyspark import TaskContext

        self.system, self.path = fs.FileSystem.from_uri(file_uri(folder))
        self.system.create_dir(self.path, recursive=True)
        self.folder, self.suffix, self.most = folder, suffix, most
        self.name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        self.n, self.out = 0, None

    def write(self, data: bytes) -> tuple[str, int]:
        """The file's address and the offset at which ``data`` begins."""
        if self.out is None:
            self.file, self.at = f"{self.name}-{self.n}{self.suffix}", 0
            self.out = self.system.open_output_stream(f"{self.path}/{self.file}", compression=None)
            self.n += 1
        place = f"{self.folder}/{self.file}", self.at
        self.out.write(data)
        self.at += len(data)
        if self.at >= self.most:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

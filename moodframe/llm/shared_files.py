"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid


def file_system(path: str):
    """(file system, path in it) of a local path or a URI that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if path.startswith("s3a://"):
        path = "s3://" + path[len("s3a://") :]
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path)


class FileWriter:
    """A file that appears under its name when it is closed: a lost or repeated task leaves no
    half-written file, and a second writer of a name replaces it by the same bytes."""

    def __init__(self, folder: str, name: str):
        self.path = f"{folder}/{name}"
        self.system, self.final = file_system(self.path)
        self.system.create_dir(self.final.rsplit("/", 1)[0], recursive=True)
        self.draft = f"{self.final}.{uuid.uuid4().hex}.tmp"
        self.stream = self.system.open_output_stream(self.draft, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends and returns the place of the first byte."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.final)


def read_bytes(path: str, offset: int = 0, length: int | None = None) -> bytes:
    system, inner = file_system(path)
    with system.open_input_file(inner) as source:
        source.seek(offset)
        return source.read() if length is None else source.read(length)

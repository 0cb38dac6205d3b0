"""Files in the shared folder, by any scheme that Arrow's file systems know (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """uri has a scheme (see `runtime.shared_dir`); without one a path could mean another file system than Spark's."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri!r} has no scheme")
    return fs.FileSystem.from_uri(uri)


class Writer:
    """A file that gets its name when it is complete; each attempt of a task writes one of its own."""

    def __init__(self, folder: str, name: str):
        self.uri = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        system, self.path = resolve(self.uri)
        system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.at = system.open_output_stream(self.path), 0

    def append(self, data: bytes) -> tuple[int, int]:
        """Where the data came to lie: offset and length."""
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.out.close()


class Reader:
    """Range reads, with the last file kept open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = resolve(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.uri = self.file = None

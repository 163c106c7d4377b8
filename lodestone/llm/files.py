"""Files in the shared folder, by any file system that pyarrow opens (local, hdfs, s3, ...)."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """An output stream; the folder is made where the file system has folders."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def read(uri: str):
    """A seekable input."""
    system, path = opened(uri)
    return system.open_input_file(path)

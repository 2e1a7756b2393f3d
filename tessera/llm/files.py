"""Binary files of tasks in the shared folder, by pyarrow's file systems (local, HDFS, S3, GCS by URI)."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def make_folder(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)


def put(uri: str, name: str, data: bytes) -> None:
    """Write whole, then rename: a reader, and a second attempt of the task, never meets half a file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{path}/{name}")

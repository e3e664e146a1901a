"""Binary files in the shared folder, from tasks: write once under the final name, read by byte range."""

from __future__ import annotations

import posixpath
import uuid


def filesystem(uri: str):
    """(filesystem, path) of a URI such as file:///..., hdfs://... or s3://..."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def open_new(uri: str):
    """(stream, commit): bytes appear under uri only when commit is called, so a retried task is harmless."""
    files, path = filesystem(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    draft = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}.draft")
    stream = files.open_output_stream(draft)

    def commit() -> None:
        stream.close()
        files.move(draft, path)

    return stream, commit


def open_ranges(uri: str):
    files, path = filesystem(uri)
    return files.open_input_file(path)


def make_folder(uri: str) -> str:
    files, path = filesystem(uri)
    files.create_dir(path, recursive=True)
    return uri

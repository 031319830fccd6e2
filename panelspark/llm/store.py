"""Binary files in the shared folder, written by tasks and mapped or read by workers."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow.fs as pafs


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks: list[bytes]) -> None:
    """Write under another name, then rename: a lost or repeated task leaves no half file."""
    fs, path = _at(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        for c in chunks:
            f.write(c)
    fs.move(part, path)


def local_file(uri: str) -> str:
    """A local path of the file to map; one in a remote store is copied once a worker."""
    fs, path = _at(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return path
    own = os.path.join(tempfile.gettempdir(), "mapped-" + hashlib.sha1(uri.encode()).hexdigest())
    if not os.path.exists(own):
        part = f"{own}.{uuid.uuid4().hex}"
        pafs.copy_files(path, part, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        os.replace(part, own)
    return own


def read_range(uri: str, start: int, size: int) -> bytes:
    fs, path = _at(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(size, start)


def file_size(uri: str) -> int:
    fs, path = _at(uri)
    return fs.get_file_info(path).size

"""Files in the shared folder, from driver and workers alike, by their URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def make_dir(uri: str) -> None:
    system, path = _at(uri)
    system.create_dir(path, recursive=True)


def writer(uri: str):
    """A stream that creates the file; it counts as written when closed."""
    system, path = _at(uri)
    return system.open_output_stream(path, compression=None)


def reader(uri: str):
    """A file for reads of ranges: ``read_at(length, offset)``, or as a stream."""
    system, path = _at(uri)
    return system.open_input_file(path)


def own_name(folder: str, kind: str, part: int, suffix: str) -> str:
    """A name no other task attempt uses, so a repeated task never overwrites what a finished one reported."""
    return f"{folder}/{kind}-{part:05d}-{uuid.uuid4().hex[:12]}{suffix}"

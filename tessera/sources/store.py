"""Files of any store that pyarrow opens, from the driver and from Python workers: plain paths, and URIs such as hdfs:// and s3://."""

from __future__ import annotations

import fnmatch
import posixpath

import pyarrow as pa
from pyarrow import fs


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def kind(path: str) -> str:
    """"file", "folder" or "" of a path."""
    store, at = open_store(path)
    found = store.get_file_info(at).type
    return {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(found, "")


def listed(path: str, *patterns: str) -> list[str]:
    """The files of a folder whose names fit one of the patterns, in any case, as paths of the same store."""
    store, at = open_store(path)
    names = [posixpath.basename(x.path) for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type == fs.FileType.File]
    return [f"{path.rstrip('/')}/{n}" for n in names if any(fnmatch.fnmatch(n.lower(), p.lower()) for p in patterns)]


def size_of(path: str) -> int:
    store, at = open_store(path)
    return store.get_file_info(at).size


def read_range(path: str, start: int, n: int) -> bytes:
    store, at = open_store(path)
    with store.open_input_file(at) as f:
        f.seek(start)
        return f.read(n)


class Replacing:
    """A file written beside its place, which takes the place when the writing has ended well: a task that runs again replaces its own file."""

    def __init__(self, path: str) -> None:
        self.store, self.path = open_store(path)
        folder, name = posixpath.split(self.path)
        self.store.create_dir(folder, recursive=True)
        self.part = posixpath.join(folder, f".{name}.part")

    def __enter__(self) -> pa.NativeFile:
        self.out = self.store.open_output_stream(self.part)
        return self.out

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.store.move(self.part, self.path)

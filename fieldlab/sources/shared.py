"""Files that Python data sources read and write, wherever pyarrow's file systems reach."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


@contextmanager
def whole(system: fs.FileSystem, path: str) -> Iterator:
    """A file that appears under its name only once it is written to the end."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}.draft"
    try:
        with system.open_output_stream(draft) as out:
            yield out
    except BaseException:
        remove(system, draft)
        raise
    system.move(draft, path)


def remove(system: fs.FileSystem, path: str) -> None:
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)


def listed(system: fs.FileSystem, path: str, *ends: str) -> list[fs.FileInfo]:
    """A file, or the files of a folder whose names end so; hidden ones are left out."""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(path))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name.endswith(ends) and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)

"""Folders by URI: one or many as a list, and the next free numbered one for results."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain, count
from os import PathLike, fspath


def as_paths(paths: str | PathLike | Iterable[str | PathLike]) -> list[str]:
    """One path or several as a list of texts."""
    return [fspath(paths)] if isinstance(paths, (str, PathLike)) else [fspath(p) for p in paths]


def free_folder(parent: str, name: str = "results") -> str:
    """<parent>/<name>, or the first of <name>1, <name>2, ... that is missing or empty; it is there afterwards."""
    from pyarrow import fs

    uri = parent if "://" in parent else f"file://{parent}"
    files, root = fs.FileSystem.from_uri(uri.rstrip("/"))
    for end in chain([""], map(str, count(1))):
        path = f"{root}/{name}{end}"
        if files.get_file_info(path).type == fs.FileType.NotFound or not files.get_file_info(fs.FileSelector(path)):
            files.create_dir(path, recursive=True)
            return f"{parent.rstrip('/')}/{name}{end}"
    raise AssertionError

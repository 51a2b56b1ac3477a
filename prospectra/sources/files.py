"""Files for Python data sources, on any store that pyarrow knows by its URI."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI or a plain path."""
    if "://" in path or path.startswith("file:"):
        scheme, rest = path.split(":", 1)
        if scheme == "file":
            return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def list_files(path: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of every file below ``path``, hidden ones and markers left out, in order of name."""
    store, at = open_store(path)
    for info in sorted(store.get_file_info(pafs.FileSelector(at, recursive=True)), key=lambda i: i.path):
        inner = info.path[len(at) :].strip("/").split("/")
        if info.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in inner):
            yield info.path, info.size


def packed(files: Iterator[tuple[str, int]], target: int, open_cost: int) -> list[list[tuple[str, int]]]:
    """Files in order, packed into groups of about ``target`` bytes, each file counted with ``open_cost`` more."""
    groups: list[list[tuple[str, int]]] = []
    held = target
    for path, size in files:
        if held + size + open_cost > target and (held >= target or groups[-1]):
            groups.append([])
            held = 0
        groups[-1].append((path, size))
        held += size + open_cost
    return groups

"""Byte ranges of one file, read in parallel."""

from __future__ import annotations

from pyarrow import fs


def resolve(path: str):
    """(file system, path) of a URI or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def size(path: str) -> int:
    fsys, p = resolve(path)
    info = fsys.get_file_info(p)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return info.size


def read(path: str, start: int, length: int) -> bytes:
    fsys, p = resolve(path)
    with fsys.open_input_file(p) as f:
        f.seek(start)
        return f.read(length)


def ranges(start: int, end: int, step: int) -> list[tuple[int, int, int]]:
    """(number, start, end) of the pieces of [start, end)."""
    return [(i, a, min(a + step, end)) for i, a in enumerate(range(start, end, step))]

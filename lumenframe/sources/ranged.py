"""Files read by ranges, where a reader needs a few bytes of a large file.

Arrow's file systems are used: local paths, ``file:``, ``hdfs:``, ``s3:`` and the others that Arrow knows. The
bytes that were asked for are counted.
"""

from __future__ import annotations

import io

import pyarrow.fs as pafs


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; Hadoop's ``file:/x`` counts as ``file:///x``."""
    if path.startswith("file:"):
        from urllib.parse import unquote

        return pafs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Ranged(io.RawIOBase):
    """A file that is read at given places; ``asked`` counts the bytes."""

    def __init__(self, path: str):
        fs, at = place(path)
        self.file = fs.open_input_file(at)
        self.length, self.at, self.asked = self.file.size(), 0, 0

    def range(self, start: int, n: int) -> bytes:
        data = self.file.read_at(max(0, min(n, self.length - start)), start)
        self.asked += len(data)
        return data

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.length)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        data = self.range(self.at, self.length - self.at if n is None or n < 0 else n)
        self.at += len(data)
        return data

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def listed(folder: str, suffixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder, or of the one file that it is, by name; hidden ones and others than the suffixes left out."""
    fs, at = place(folder)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        return []
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    head = folder.split("://", 1)[0] + "://" if "://" in folder else "file://" if folder.startswith("file:") else ""
    files = [(f"{head}{f.path}", f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted(f for f in files if not suffixes or f[0].endswith(suffixes))


def whole(path: str) -> bytes:
    with Ranged(path) as f:
        return f.read()

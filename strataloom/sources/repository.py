"""A Spark data source that scans working trees of repositories.

``spark.read.format("repository").option("path", root).load()`` gives one row per file that a scan keeps. Options:
``max_bytes``, ``strict`` (an unreadable or changing file fails the scan instead of looking deleted). Dot files are
read; what the built-in binary source hides is not hidden here.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths

SCHEMA = "repository string, path string, size_bytes long, content_hash string, content binary"


class ScanError(RuntimeError):
    """A strict scan met something it could not read, or that changed while it read."""


def denied(name: str) -> bool:
    """The rule of :func:`strataloom.functions.paths.denied_file` for one name."""
    n = name.casefold()
    if n in paths.SAFE_TEMPLATES:
        return False
    if n in paths.SECRET_NAMES or n.startswith(".env.") or n in paths.DENIED_NAMES:
        return True
    return n.endswith(tuple(paths.DENIED_ENDINGS)) or PurePosixPath(n).suffix in paths.DENIED_SUFFIXES


class _Tree(InputPartition):
    def __init__(self, root: str, top: str | None):
        super().__init__((root, top))
        self.root, self.top = root, top


def _entries(folder: Path, strict: bool) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError as e:
        if strict:
            raise ScanError(f"cannot list {folder.name}") from e
        return []


def _control(name: str) -> bool:
    return any(ord(ch) < 32 or ord(ch) == 127 for ch in name)


def _same(a: os.stat_result, b: os.stat_result) -> bool:
    return (a.st_ino, a.st_size, a.st_mtime_ns, a.st_ctime_ns) == (b.st_ino, b.st_size, b.st_mtime_ns, b.st_ctime_ns)


def _read(path: Path, most: int, strict: bool) -> bytes | None:
    """Bytes of a regular file of at most ``most`` bytes that did not change meanwhile and looks like text."""
    try:
        before = path.lstat()
        if not stat.S_ISREG(before.st_mode) or before.st_size > most:
            return None
        with path.open("rb") as f:
            data = f.read(most + 1)
            after = os.fstat(f.fileno())
        if not _same(before, after) or len(data) != before.st_size:
            if strict:
                raise ScanError(f"{path.name} changed while it was read")
            return None
    except OSError as e:
        if strict:
            raise ScanError(f"cannot read {path.name}") from e
        return None
    return None if b"\x00" in data[: paths.SNIFF_BYTES] else data


def scan(root: str, top: str | None = None, most: int = paths.MAX_FILE_BYTES, strict: bool = False) -> Iterator[tuple[str, bytes]]:
    """(relative path, bytes) of the files kept under ``root``; of one entry of it if ``top`` is given, else of its
    own files only."""
    base = Path(root)
    todo = [base / top] if top else [base]
    while todo:
        folder = todo.pop()
        entries = _entries(folder, strict)
        if folder != base and any(e.name == ".git" for e in entries):
            continue  # a repository inside the repository
        for e in entries:
            if _control(e.name) or e.is_symlink():
                continue
            if e.is_dir(follow_symlinks=False):
                if top and e.name.casefold() not in paths.DENIED_DIRECTORIES:
                    todo.append(Path(e.path))
            elif not denied(e.name):
                data = _read(Path(e.path), most, strict)
                if data is not None:
                    yield Path(e.path).relative_to(base).as_posix(), data


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("path", "").split(",") if r]
        self.most = int(options.get("max_bytes", paths.MAX_FILE_BYTES))
        self.strict = str(options.get("strict", "false")).lower() == "true"
        if not self.roots:
            raise ValueError("the option path is needed")

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for root in self.roots:
            if not Path(root).is_dir():
                raise ScanError("the root is no directory")
            parts.append(_Tree(root, None))
            for e in _entries(Path(root), self.strict):
                if e.is_dir(follow_symlinks=False) and not _control(e.name) and e.name.casefold() not in paths.DENIED_DIRECTORIES:
                    parts.append(_Tree(root, e.name))
        return parts

    def read(self, partition: _Tree):
        import hashlib

        for path, data in scan(partition.root, partition.top, self.most, self.strict):
            yield Path(partition.root).name, path, len(data), hashlib.sha256(data).hexdigest(), data


class RepositorySource(DataSource):
    """The data source ``repository``."""

    @classmethod
    def name(cls) -> str:
        """Its name in ``spark.read.format``."""
        return "repository"

    def schema(self) -> str:
        """The columns of a scan."""
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        """The reader of a scan."""
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(RepositorySource)

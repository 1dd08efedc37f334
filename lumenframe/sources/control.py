"""Control files as a stream: a folder with a file for each kind of request, whose text is its latest token."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FORMAT = "control_files"


class _Reader(SimpleDataSourceStreamReader):
    """The offset is the last token of each kind, so a restart repeats no request and a replayed batch has the same rows."""

    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", "_request")
        self.kinds = [k.strip() for k in options["kinds"].split(",")] if options.get("kinds") else None
        group = options.get("group", "").strip()
        if group:
            if not re.fullmatch(r"[A-Za-z0-9_-]+", group):
                raise ValueError(f"a group has ASCII letters, digits, _ and - only, not {group!r}")
            self.folder = f"{self.folder.rstrip('/')}/groups/{group}"
        self.known = options.get("start", "latest")

    def _tokens(self) -> dict[str, str]:
        from .ranged import listed, whole

        out = {}
        for path, size in listed(self.folder):
            name = path.rsplit("/", 1)[-1]
            kind = name[: -len(self.suffix)]
            if name.endswith(self.suffix) and kind and (self.kinds is None or kind in self.kinds) and size <= 1 << 16:
                if token := whole(path).decode("utf-8", "replace").strip():
                    out[kind] = token
        return out

    def initialOffset(self) -> dict:
        # what is there when a stream starts for the first time was asked of another run
        return self._tokens() if self.known == "latest" else {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {**start, **self._tokens()}  # a file that is gone, or empty, keeps its last token
        return self._changed(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._changed(start, end)

    def _changed(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(k, end[k]) for k in sorted(end) if end[k] != start.get(k)])

    def commit(self, end: dict) -> None:
        pass


class ControlFiles(DataSource):
    """Requests (kind, token): one for each kind whose token has changed since the last batch; of several changes, the last.

    Options: ``path``, the folder; ``suffix`` of its files (``_request``); ``kinds``, those to look at, by commas (all); ``group``, a
    subfolder of ``groups``; ``start``, whether the first batch takes what is there (``earliest``) or passes over it (``latest``). A
    folder or file that is missing has no request. The driver reads the files: a few bytes for each kind.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "kind string, token string"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def control_stream(spark: SparkSession, path: str, **options: str):
    """The requests of a control folder as a stream."""
    spark.dataSource.register(ControlFiles)
    return spark.readStream.format(FORMAT).options(**options).load(path)

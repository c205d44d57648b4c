"""Paged collections as a data source: pages that a fetcher has left, each naming the next, are followed from the first.

A landing folder has collection=<name>/token=<token>/*.json, one document {"rows": [...], "next": token or null} for each page; the first
page's token is "first". A collection ends where a page names no next one, or where the named page is missing or unreadable.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIRST = "first"
SCHEMA = "collection string, page int, position int, row string"


@dataclass
class Pages(InputPartition):
    """Pages of a collection from one token on, which is the page numbered `page`; all, or so many."""

    collection: str
    token: str
    page: int
    most: int


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def collections(path: str) -> list[str]:
    files, at = _files(path)
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name.removeprefix("collection=") for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("collection="))


def page(path: str, collection: str, token: str) -> dict | None:
    """A page's document, or None where it is missing or can't be read."""
    files, at = _files(f"{path}/collection={collection}/token={token}")
    for f in sorted(files.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda f: f.base_name):
        if f.base_name.endswith(".json"):
            try:
                with files.open_input_stream(f.path) as stream:
                    made = json.loads(stream.read())
                return made if isinstance(made.get("rows"), list) else None
            except (ValueError, AttributeError):
                return None
    return None


def follow(path: str, start: Pages) -> Iterator[tuple[int, dict]]:
    """Numbers and documents of the pages from a token on."""
    token, number = start.token, start.page
    while token and number < start.page + start.most:
        found = page(path, start.collection, token)
        if found is None:
            return
        yield number, found
        token, number = found.get("next"), number + 1


def _rows(path: str, part: Pages | None) -> Iterator[tuple]:
    """The rows of a partition; Spark asks with None where there is none."""
    for number, found in follow(path, part) if part else ():
        for position, row in enumerate(found["rows"]):
            yield part.collection, number, position, row if isinstance(row, str) else json.dumps(row)


class Paged(DataSource):
    """spark.read.format("paged").load(path), or readStream: collection, page, position, row (a string, or JSON).

    Options: most_pages of a collection (80). One task follows one collection, as each page is named by the one before.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], int(self.options.get("most_pages", 80)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("most_pages", 80)))


class _Batch(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Pages]:
        return [Pages(c, FIRST, 0, self.most) for c in collections(self.path)]

    def read(self, part: Pages | None) -> Iterator[tuple]:
        return _rows(self.path, part)


class _Stream(DataSourceStreamReader):
    """An offset says for each collection how many pages have been read, and the token of the next one."""

    def __init__(self, path: str, most: int):
        self.path, self.most, self.last = path, most, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for c in collections(self.path):
            number, token = self.last.get(c, [0, FIRST])
            if token:
                for number, found in follow(self.path, Pages(c, token, number, self.most - number)):  # noqa: B020
                    self.last[c] = [number + 1, found.get("next")]
        return dict(self.last)

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.last = self.last or dict(end)
        out = []
        for c, (to, _) in end.items():
            number, token = start.get(c, [0, FIRST])
            if token and to > number:
                out.append(Pages(c, token, number, to - number))
        return out

    def read(self, part: Pages | None) -> Iterator[tuple]:
        return _rows(self.path, part)

"""A replayed paged source: responses of one question as numbered page files.

Layout: ``<folder>/<question id>/page-<n>.json``, each ``{"data": [...], "paging": {"is_end": bool}}``.
The reader keeps the rules of the live source: it stops only where a page says so, an empty page without that,
a page whose first five ids repeat those before, a page that is no list, or more than ``cap`` (300) pages of one reading are errors.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from strataloom.sources import schemas

CAP, HEAD = 300, 5


class PagingError(ValueError):
    """The pages of a question break the rules of the source."""


def page_files(folder: str, question: str) -> list[str]:
    base = os.path.join(folder, question)
    numbered = [(int(m[1]), name) for name in os.listdir(base) if (m := re.fullmatch(r"page-(\d+)\.json", name))]
    return [os.path.join(base, name) for _, name in sorted(numbered)]


def _answer(item: dict) -> tuple:
    author = item.get("author")
    return (
        str(item.get("id", "")), (author or {}).get("name") or "" if isinstance(author, dict) else "", item.get("content") or "", item.get("excerpt") or "",
        int(item.get("voteup_count") or 0), int(item.get("comment_count") or 0), item.get("created_time"), item.get("updated_time"),
    )


def read_pages(folder: str, question: str, start: int = 0, cap: int = CAP) -> Iterator[tuple]:
    """The pages of one question from page ``start`` on: (question, page, offset, is_end, answers)."""
    before: list[str] | None = None
    offset, files = 0, page_files(folder, question)
    for number, path in enumerate(files):
        with open(path, encoding="utf-8") as file:
            page = json.load(file)
        data = page.get("data") if isinstance(page, dict) else None
        if not isinstance(data, list):
            raise PagingError(f"{question}: page {number} has no list")
        end = isinstance(page.get("paging"), dict) and page["paging"].get("is_end") is True
        if not data and not end:
            raise PagingError(f"{question}: page {number} is empty but not the end")
        head = [str(x.get("id", "")) for x in data[:HEAD]]
        if data and head == before:
            raise PagingError(f"{question}: page {number} repeats the page before")
        before = head
        if number >= start:
            if number - start >= cap:
                raise PagingError(f"{question}: more than {cap} pages")
            yield question, number, offset, end, [_answer(x) for x in data]
        offset += len(data)
        if end:
            return


class _Question(InputPartition):
    def __init__(self, question: str, start: int = 0, stop: int | None = None) -> None:
        super().__init__(question)
        self.question, self.start, self.stop = question, start, stop


class _Reader(DataSourceReader):
    def __init__(self, folder: str, cap: int = CAP) -> None:
        self.folder, self.cap = folder, cap

    def partitions(self) -> list[InputPartition]:
        return [_Question(q) for q in sorted(os.listdir(self.folder)) if re.fullmatch(r"[0-9]{1,20}", q)]

    def read(self, partition: _Question) -> Iterator[tuple]:
        yield from read_pages(self.folder, partition.question, cap=self.cap)


class _StreamReader(DataSourceStreamReader):
    """The offset is the number of pages of each question that were read; a restart goes on behind it."""

    def __init__(self, folder: str, cap: int = CAP) -> None:
        self.folder, self.cap = folder, cap

    def initialOffset(self) -> dict:
        return {"pages": "{}"}

    def latestOffset(self) -> dict:
        there = {q: len(page_files(self.folder, q)) for q in sorted(os.listdir(self.folder)) if re.fullmatch(r"[0-9]{1,20}", q)}
        return {"pages": json.dumps(there, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["pages"]), json.loads(end["pages"])
        return [_Question(q, old.get(q, 0), n) for q, n in new.items() if n > old.get(q, 0)]

    def read(self, partition: _Question) -> Iterator[tuple]:
        for row in read_pages(self.folder, partition.question, partition.start, self.cap):
            if partition.stop is not None and row[1] >= partition.stop:
                return
            yield row

    def commit(self, end: dict) -> None:
        pass


class ReplayPages(DataSource):
    """``spark.read.format("replay_pages").option("path", folder)``, or ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "replay_pages"

    def schema(self) -> str:
        return schemas.PAGE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("cap", CAP)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("cap", CAP)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplayPages)

"""A paged source as a Python data source: one partition for each chain of pages in a batch, one page after another in a stream.

A chain is what one search term gives: its first page has no token, every page names the token of the next one, the last
names none (or has no items). Pages that the source is too busy for are asked for again, others that fail are asked for a
few times; then the read fails, or, if `lenient`, the chain ends there, as later pages cannot be named.

Options: `base`, an http(s) address or a folder that plays the source (term=T/token=K/part-*, K is `first` for the first page),
`terms` (separated by commas), `items` (the field that holds a page's items), `retries`, `pause` (seconds), `lenient`.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

FIRST = "first"


class Busy(Exception):
    """The source asks to come back later."""


def _fetched(base: str, term: str, token: str, params: dict[str, str]) -> dict:
    if base.startswith(("http://", "https://")):
        asked = params | {"query.term": term} | ({"pageToken": token} if token else {})
        try:
            with urllib.request.urlopen(f"{base}?{urllib.parse.urlencode(asked)}", timeout=30) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise Busy from e
            raise
    folder = os.path.join(base.removeprefix("file://").removeprefix("file:"), f"term={term}", f"token={token or FIRST}")
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    with open(os.path.join(folder, parts[0]), encoding="utf-8") as f:
        return json.load(f)


class Pages:
    """The pages of a source, with its options."""

    def __init__(self, options: dict[str, str]):
        self.base, self.items = options["base"], options.get("items", "studies")
        self.terms = [t for t in options.get("terms", "").split(",") if t]
        self.retries, self.pause, self.lenient = int(options.get("retries", "3")), float(options.get("pause", "0.3")), options.get("lenient", "false") == "true"
        self.params = {k.removeprefix("param."): v for k, v in options.items() if k.startswith("param.")}

    def page(self, term: str, token: str) -> tuple[list, str]:
        """(items, next token) of a page; the next token is empty at the end of the chain."""
        tries = 0
        while True:
            try:
                got = _fetched(self.base, term, token, self.params)
                items = got.get(self.items) or []
                return items, (got.get("nextPageToken") or "") if items else ""
            except Busy:
                time.sleep(max(self.pause, 2.0))
            except (OSError, ValueError, IndexError):
                tries += 1
                if tries > self.retries:
                    if self.lenient:
                        return [], ""
                    raise
                time.sleep(self.pause * tries)


class Chain(InputPartition):
    def __init__(self, term: str):
        self.term = term


class ChainReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages = Pages(options)

    def partitions(self) -> list[Chain]:
        return [Chain(t) for t in self.pages.terms]

    def read(self, partition: Chain) -> Iterator[tuple]:
        if partition is None:
            return
        token = ""
        while True:
            items, after = self.pages.page(partition.term, token)
            for item in items:
                yield partition.term, token, json.dumps(item, ensure_ascii=False)
            if not after:
                return
            token = after


class PageStream(SimpleDataSourceStreamReader):
    """The offset is the term and the token of the page that comes next; a restart goes on from it."""

    def __init__(self, options: dict[str, str]):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:
        return {"term": 0, "token": ""}

    def _one(self, at: dict) -> tuple[list[tuple], dict]:
        if at["term"] >= len(self.pages.terms):
            return [], at
        term = self.pages.terms[at["term"]]
        items, after = self.pages.page(term, at["token"])
        rows = [(term, at["token"], json.dumps(item, ensure_ascii=False)) for item in items]
        return rows, {"term": at["term"], "token": after} if after else {"term": at["term"] + 1, "token": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, after = self._one(start)
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while at != end and at["term"] < len(self.pages.terms):
            rows, at = self._one(at)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """(term, pageToken, item): every item of every page, as JSON."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_pages"

    def schema(self) -> str:
        return "term string, pageToken string, item string"

    def reader(self, schema) -> ChainReader:
        return ChainReader(dict(self.options))

    def simpleStreamReader(self, schema) -> PageStream:
        return PageStream(dict(self.options))


def paged(spark, base: str, terms: list[str], items: str = "studies", **options: str):
    """Items (term, pageToken, item) of all chains, each read by a task of its own."""
    spark.dataSource.register(PagedSource)
    return spark.read.format(PagedSource.name()).options(base=base, terms=",".join(terms), items=items, **options).load()


def paged_stream(spark, base: str, terms: list[str], items: str = "studies", **options: str):
    """The same as a stream, a page for each trigger."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format(PagedSource.name()).options(base=base, terms=",".join(terms), items=items, **options).load()

"""Saved runs as a data source that reads no more than is asked for: one partition a file, filters taken in by the source.

``spark.read.format("saved_runs").load(path)`` gives (platform, page, file, pos, price, raw). A filter on the platform or the page
drops files by their names or folders before any is opened, one on the price (a budget) drops cards before they leave the
reader; every other filter stays with Spark. A run is a folder of JSON documents (an array of cards, or one that wraps it) or of
lines of cards; folders ``platform=<p>`` and ``page=<n>`` and names ``<platform>...`` and ``...-p<n>.json`` tell where a file comes from.

The folder may be in any store that Arrow's file systems know. ``raw`` is JSON text: ``F.parse_json("raw")`` gives what ``runs.listings`` takes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .runs import KEYS, PLATFORMS, WRAPPERS

SCHEMA = "platform string, page int, file string, pos int, price double, raw string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Cards of a file that are looked at for its platform.
LOOKED_AT = 20


class Saved(NamedTuple):
    """A file and what its name tells: null where it doesn't."""

    path: str
    platform: str | None
    page: int | None


class Part(InputPartition):
    def __init__(self, file: Saved) -> None:
        super().__init__(file.path)
        self.file = file


def told_by_name(path: str) -> Saved:
    parts = dict(x.split("=", 1) for x in path.split("/")[:-1] if "=" in x)
    name = path.rsplit("/", 1)[-1]
    platform = unquote(parts["platform"]) if "platform" in parts else next((p for p in PLATFORMS if name.startswith(p)), None)
    page = parts.get("page") or (m[1] if (m := re.search(r"-p(\d+)\.json$", name)) else None)
    return Saved(path, platform, int(page) if page and page.isdigit() else None)


def cards_of(text: str) -> list[object]:
    """The cards of a file: an array, what a document wraps, a document, or lines of documents."""
    try:
        whole = json.loads(text)
    except ValueError:
        return [json.loads(line) for line in text.splitlines() if line.strip()]
    if isinstance(whole, list):
        return whole
    return next((whole[w] for w in WRAPPERS if isinstance(whole, dict) and isinstance(whole.get(w), list)), [whole])


def price_of(card: dict) -> float | None:
    """As ``parse.money``: digits and dots up to a second dot, if over zero; money in an object is its value, amount, price or raw."""
    for key in KEYS["price"]:
        v = card.get(key)
        if isinstance(v, dict):
            v = next((v[k] for k in ("value", "amount", "price", "raw") if v.get(k) is not None), None)
        if v is not None:
            m = re.match(r"\d*\.?\d+|\d+\.?", re.sub(r"[^0-9.]", "", v if isinstance(v, str) else json.dumps(v)))
            return float(m[0]) if m and float(m[0]) > 0 else None
    return None


def label_of(cards: Iterable[dict]) -> str:
    """The platform that the first cards' labels and addresses name."""
    for card in cards:
        given = card.get("input")
        label = " ".join(str(x) for x in (card.get("platform"), card.get("url"), card.get("product_url"), given.get("url") if isinstance(given, dict) else None) if x).lower()
        named = next((p for p in PLATFORMS if p in label), None)
        if named:
            return named
    return "unknown"


_TESTS: dict[type, Callable[[object, object], bool]] = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.tests = path, {"platform": [], "page": [], "price": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            of = getattr(f, "attribute", ())
            own = self.tests.get(of[0]) if len(of) == 1 else None
            if own is None or type(f) not in _TESTS:
                yield f
            else:
                own.append((type(f), f.value))

    def passes(self, column: str, value: object) -> bool:
        """Whether a value holds under every filter that was taken in; a null holds under none."""
        return all(value is not None and _TESTS[kind](value, wanted) for kind, wanted in self.tests[column])

    def partitions(self) -> list[Part]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [told_by_name(f.path) for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[_.]|manifest\.json$", f.path[len(root) :]) and re.search(r"\.(json|txt)$", f.path)]
        # A file whose name is silent has to be opened to be known.
        return [Part(f) for f in sorted(files) if (f.platform is None or self.passes("platform", f.platform)) and self.passes("page", f.page)]

    def read(self, partition: Part) -> Iterator[tuple]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        file = partition.file
        with store.open_input_stream(file.path) as stream:
            cards = cards_of(stream.read().decode())
        # Names of folders come before those of the runs' reader: a file's first cards tell its platform where nothing else does.
        platform = file.platform or label_of(c for c in cards[:LOOKED_AT] if isinstance(c, dict))
        if self.passes("platform", platform):
            for pos, card in enumerate(cards):
                if isinstance(card, dict) and self.passes("price", price := price_of(card)):
                    yield platform, file.page, file.path.rsplit("/", 1)[-1], pos, price, json.dumps(card)


class SavedRuns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_runs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(self.options["path"])


def saved_runs(spark: SparkSession, path: str) -> DataFrame:
    """The cards of the runs under ``path``; filters on platform, page and price go to the source."""
    spark.dataSource.register(SavedRuns)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("saved_runs").load(path)


def as_cards(saved: DataFrame) -> DataFrame:
    """What ``runs.listings`` and ``runs.health`` take."""
    return saved.select("platform", "file", "pos", F.parse_json("raw").alias("raw"))


def save(raw: DataFrame, path: str) -> None:
    """Cards (platform, page, raw: JSON text) as lines, a folder for each platform and page."""
    raw.select("platform", "page", "raw").write.partitionBy("platform", "page").mode("errorifexists").text(path)

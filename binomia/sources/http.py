"""Catalogue pages and API rows over HTTP as data sources. Requests are made by executors, a partition a query or a page."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from itertools import product
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, In, InputPartition

RETRIES, BACKOFF_S, TIMEOUT_S = 3, 10.0, 20
PAGE = 200
# Fixed values. The service's names of filters: on a row's own fields, and on lists that a row has.
OWN = {"language": "language", "is_oa": "is_oa", "type": "type"}
ASKED = {"concept": "concepts.id", "country": "authorships.institutions.country_code"}


def fetch(url: str, retries: int = RETRIES, wait: float = BACKOFF_S, get=None) -> str | None:
    """The body, or None when the last attempt fails too; waits double. get: a function of the URL, for tests."""
    get = get or (lambda u: urlopen(u, timeout=TIMEOUT_S).read().decode())  # noqa: S310
    for attempt in range(retries):
        try:
            return get(url)
        except (HTTPError, URLError, OSError):
            if attempt + 1 < retries:
                time.sleep(wait)
                wait *= 2
    return None


class Query(InputPartition):
    def __init__(self, genus: str, species: str, family: str) -> None:
        self.genus, self.species, self.family = genus, species, family


class CataloguePages(DataSource):
    """(genus, species, family, html): a page a query; html is null where the request failed. Options: url, queries (JSON array of [genus, species, family]; by family and epithet where genus is empty)."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "genus string, species string, family string, html string"

    def reader(self, schema) -> DataSourceReader:
        return CatalogueReader(self.options)


class CatalogueReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.url, self.queries = options["url"], json.loads(options.get("queries", "[]"))
        self.wait = float(options.get("wait", BACKOFF_S))

    def partitions(self) -> list[InputPartition]:
        return [Query(*q) for q in self.queries]

    def read(self, partition: Query) -> Iterator[tuple]:
        by = {"genus": partition.genus} if partition.genus else {"family": partition.family}
        url = f"{self.url}?{urlencode({'tbl': 'species', **by, 'species': partition.species})}"
        yield partition.genus, partition.species, partition.family, fetch(url, wait=self.wait)


class Failed(OSError):
    """A page that could not be read: what was read so far is not all there is."""


FIELDS = "id,doi,title,publication_year,language,type,cited_by_count,authorships,primary_location,open_access"


class Chain(InputPartition):
    """Pages along a cursor, of one year and one value of each list asked for."""

    def __init__(self, year: int | None, asked: dict[str, str], cursor: str = "*", pages: int | None = None) -> None:
        self.year, self.asked, self.cursor, self.pages = year, asked, cursor, pages


class Works(DataSource):
    """API rows, newest first, page by page along a cursor. Filters on year, language, open access, type, concept and country go to the service.

    concept and country are asked for, not told, as a row has many: they hold the value a row was asked for by, or null where none is. Of several values each is asked for alone, so a
    row that has two of them comes twice, once by each. Options: url; pages: at most so many of each chain; years, as 2001-2024: a partition a year; filter: more for the service; wait: seconds before the
    first retry. A page that fails ends the reading with an error. As a stream the offset is each year's cursor: a query that breaks off goes on with the page that failed.
    """

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return "doi string, title string, year int, language string, is_oa boolean, type string, concept string, country string, cited_by_count int, raw string"

    def reader(self, schema) -> DataSourceReader:
        return WorksReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return WorksStream(self.options)


def _years(options) -> list[int | None]:
    if "years" not in options:
        return [None]
    first, _, last = options["years"].partition("-")
    return list(range(int(first), int(last or first) + 1))


class _Service:
    def __init__(self, options) -> None:
        self.url, self.wait = options["url"], float(options.get("wait", BACKOFF_S))
        self.filters: list[str] = [options["filter"]] if "filter" in options else []

    def page(self, chain: Chain, cursor: str, fields: str) -> tuple[list[dict], str | None]:
        """(rows, next cursor or None behind the last page)."""
        own = [*self.filters, *([f"publication_year:{chain.year}"] if chain.year is not None else []), *(f"{ASKED[k]}:{v}" for k, v in chain.asked.items())]
        body = fetch(f"{self.url}?{urlencode({'filter': ','.join(own), 'sort': 'publication_date:desc', 'per-page': PAGE, 'select': fields, 'cursor': cursor})}", wait=self.wait)
        if body is None:
            raise Failed(f"the page at cursor {cursor} of {chain.year or 'all years'} could not be read")
        page = json.loads(body)
        rows = page.get("results", [])
        return rows, ((page.get("meta") or {}).get("next_cursor") or None) if rows else None

    def rows(self, chain: Chain) -> Iterator[tuple]:
        cursor, left = chain.cursor, chain.pages
        while cursor and left != 0:
            found, cursor = self.page(chain, cursor, FIELDS)
            for w in found:
                yield w.get("doi"), w.get("title"), w.get("publication_year"), w.get("language"), (w.get("open_access") or {}).get("is_oa"), w.get("type"), chain.asked.get("concept"), chain.asked.get("country"), w.get("cited_by_count"), json.dumps(w)
            left = None if left is None else left - 1


class WorksReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.service, self.pages, self.years = _Service(options), int(options.get("pages", 50)), _years(options)
        self.asked: dict[str, list[str]] = {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            several = isinstance(f, In) and f.value
            if isinstance(f, GreaterThan) and name == "year":
                self.service.filters.append(f"publication_year:>{f.value}")
            elif isinstance(f, EqualTo) and name in OWN:
                self.service.filters.append(f"{OWN[name]}:{str(f.value).lower() if isinstance(f.value, bool) else f.value}")
            elif (isinstance(f, EqualTo) or several) and name in ASKED and name not in self.asked:
                self.asked[name] = [f.value] if isinstance(f, EqualTo) else sorted(set(f.value))
            yield f  # Spark looks at the rows again

    def partitions(self) -> list[InputPartition]:
        names = list(self.asked)
        return [Chain(year, dict(zip(names, values, strict=True)), pages=self.pages) for year in self.years for values in product(*self.asked.values())]

    def read(self, partition: Chain) -> Iterator[tuple]:
        yield from self.service.rows(partition)


class WorksStream(DataSourceStreamReader):
    """Offset: the cursor of each year's next page, null behind its last. The driver asks only where pages begin; executors read them, a partition a page."""

    def __init__(self, options) -> None:
        self.service, self.years, self.pages = _Service(options), _years(options), int(options.get("pages", 50))
        self.known: dict[tuple[str, str], str | None] = {}
        self.at: dict[str, str | None] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {str(y): "*" for y in self.years}

    def _next(self, year: str, cursor: str) -> str | None:
        if (year, cursor) not in self.known:
            self.known[year, cursor] = self.service.page(self._chain(year, cursor), cursor, "id")[1]
        return self.known[year, cursor]

    def _chain(self, year: str, cursor: str) -> Chain:
        return Chain(None if year == "None" else int(year), {}, cursor, 1)

    def latestOffset(self) -> dict:  # noqa: N802
        """At most `pages` pages of each year on from where this reader is."""
        now = dict(self.at or self.initialOffset())
        for year in now:
            for _ in range(self.pages):
                if now[year] is None:
                    break
                now[year] = self._next(year, now[year])
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)
        out = []
        for year, stop in end.items():
            cursor = start.get(year, "*")
            while cursor is not None and cursor != stop:
                out.append(self._chain(year, cursor))
                cursor = self._next(year, cursor)
        return out

    def read(self, partition: Chain) -> Iterator[tuple]:
        yield from self.service.rows(partition)

    def commit(self, end: dict) -> None:
        self.known = {k: v for k, v in self.known.items() if end.get(k[0]) is not None}


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CataloguePages)
    spark.dataSource.register(Works)

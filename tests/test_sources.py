"""Files, HTTP sources and sinks."""

from __future__ import annotations

import contextlib
import json
import re
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import unquote

import pytest

from pyspark.sql import functions as F

from binomia.operators import corpus
from binomia.operators import dictionary as D
from binomia.operators.dictionary import Dictionary
from binomia.sources.ledger import Ledger
from binomia.sources import files, http, sinks
from binomia.streaming import events

DOC = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Salmo </w:t><w:t>trutta</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>'
SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c></row></sheetData></worksheet>'
SHARED = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>a,b</t></si></sst>'


def test_import(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "x.odt").write_text("?")
    (tmp_path / "bad.docx").write_text("no archive")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", DOC)
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/sharedStrings.xml", SHARED)
    got = {r.file: r for r in files.import_files(spark, str(tmp_path)).collect()}
    assert (got["a.txt"].text, got["d.docx"].text, got["s.xlsx"].text) == ("plain", "Salmo trutta\nb", '"a,b",3')
    assert got["x.odt"].text is None
    assert "unsupported" in got["x.odt"].error
    assert got["bad.docx"].error


def test_text_and_json(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("l1\n\nl2\fp2")
    (tmp_path / "t" / "b.md").write_text("no")
    assert [r.text for r in files.text_dir(spark, str(tmp_path / "t")).collect()] == ["l1\n\nl2\fp2"]
    assert [(r.page, r.line) for r in files.text_lines(spark, str(tmp_path / "t" / "a.txt")).orderBy("page", "line_no").collect()] == [(0, "l1"), (0, "l2"), (1, "p2")]
    assert files.or_empty(spark, str(tmp_path / "none"), "a long").count() == 0
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x1.json").write_text(json.dumps({"candidates_found": 3, "classifications": {"valid": 2}}, indent=1))
    row = files.json_dir(spark, str(tmp_path / "r")).collect()[0]
    assert (row.stem, row.candidates_found, row.classifications) == ("x1", 3, {"valid": 2})


def test_dictionary_round_trip(spark, tmp_path):
    valid = D.valid_names(spark.createDataFrame([(0, "Zb a", "*", "The Fish"), (1, "Aa b", "", "")], "ord long, binomial string, flags string, common_name string"))
    synonyms = D.synonym_names(spark.createDataFrame([(0, "Zz y", "Zb a")], "ord long, old_name string, new_name string"))
    d = Dictionary(valid, synonyms, D.genera_of(valid), D.common_names(spark.createDataFrame([(0, "The Fish", "Zb a")], "ord long, name string, binomial string")))
    sinks.write_dictionary(d, str(tmp_path / "d"))
    back, _ = files.dictionary_json(spark, str(tmp_path / "d"))
    assert [r.binomial for r in back.valid.orderBy("ord").collect()] == ["Zb a", "Aa b"]
    assert back.common.collect()[0].l_name == "the fish"
    assert sorted(r.l_genus for r in back.genera.collect()) == ["aa", "zb"]
    assert D.metadata(back).collect()[0].species_count == 2


class Service(BaseHTTPRequestHandler):
    fails = 1
    asked: list[str] = []

    def do_GET(self):  # noqa: N802
        Service.asked.append(unquote(self.path))
        if "family=" in self.path and Service.fails:
            Service.fails -= 1
            self.send_error(503)
            return
        if "genus=Gone" in self.path:
            self.send_error(404)
            return
        body = {"results": [{"doi": "10.1/a", "title": "t", "publication_year": 2024, "language": "en", "type": "article", "open_access": {"is_oa": True}, "cited_by_count": 1}], "meta": {"next_cursor": None if "cursor=c2" in self.path else "c2"}} if "cursor" in self.path else None
        self.send_response(200)
        self.end_headers()
        self.wfile.write((json.dumps(body) if body else f"<p>{self.path}</p>").encode())

    def log_message(self, *_):
        pass


class Pages(BaseHTTPRequestHandler):
    """Year y has y - 1999 pages of two rows; one page may be broken."""

    broken: tuple[str, str] | None = None
    asked: list[str] = []

    def do_GET(self):  # noqa: N802
        path = unquote(self.path)
        Pages.asked.append(path)
        year, cursor = re.search("publication_year:([0-9]+)", path).group(1), re.search("cursor=([^&]+)", path).group(1)
        k = 0 if cursor == "*" else int(cursor)
        if Pages.broken == (year, str(k)) and "title" in path:
            self.send_error(503)
            return
        more = k + 1 < int(year) - 1999
        body = {"results": [{"doi": f"{year}/{k}/{i}", "publication_year": int(year)} for i in range(2)], "meta": {"next_cursor": str(k + 1) if more else None}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def pages():
    s = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/q"
    s.shutdown()


@pytest.fixture
def service():
    s = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/q"
    s.shutdown()


def test_http(spark, service):
    http.register(spark)
    queries = json.dumps([["Salmo", "trutta", ""], ["Gone", "x", ""], ["", "trutta", "Salmonidae"]])
    rows = {r.species + r.genus: r.html for r in spark.read.format("catalogue").option("url", service).option("queries", queries).option("wait", "0.01").load().collect()}
    assert "genus=Salmo" in rows["truttaSalmo"]
    assert rows["xGone"] is None
    assert "family=Salmonidae" in rows["trutta"]
    works = spark.read.format("works").option("url", service).option("wait", "0.01").load()
    assert [r.doi for r in works.where("year > 2023").select("doi").collect()] == ["10.1/a", "10.1/a"]
    Service.asked.clear()
    rows = works.where("year > 2023 and language = 'en' and is_oa and type = 'article' and concept = 'C1' and country in ('US', 'CA')").collect()
    assert sorted((r.doi, r.concept, r.country) for r in rows) == [("10.1/a", "C1", c) for c in ("CA", "CA", "US", "US")]
    for part in ("publication_year:>2023", "language:en", "is_oa:true", "type:article", "concepts.id:C1", "authorships.institutions.country_code:"):
        assert part in Service.asked[-1]


def test_works_by_year(spark, pages):
    """A partition a year; a page that fails is an error, not an end."""
    http.register(spark)
    works = spark.read.format("works").option("url", pages).option("years", "2001-2003").option("wait", "0.01").load()
    Pages.broken = None
    assert works.rdd.getNumPartitions() == 3
    assert sorted(r.doi for r in works.collect()) == sorted(f"{y}/{k}/{i}" for y in (2001, 2002, 2003) for k in range(y - 1999) for i in range(2))
    Pages.broken = ("2003", "3")
    with pytest.raises(Exception, match="could not be read"):
        works.collect()
    Pages.broken = None


def test_a_stream_of_works_goes_on_where_it_broke_off(spark, pages, tmp_path):
    http.register(spark)
    ledger = Ledger(spark, str(tmp_path / "works"))

    def run() -> None:
        stream = spark.readStream.format("works").option("url", pages).option("years", "2001-2003").option("wait", "0.01").option("pages", "2").load()
        query = stream.writeStream.foreachBatch(lambda df, k: ledger.commit("works", k, {"rows": df.select("doi", "year")})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    Pages.broken, Pages.asked = None, []
    run()
    got = lambda: sorted(r.doi for r in ledger.read("rows", "doi string, year int").collect())
    every = sorted(f"{y}/{k}/{i}" for y in (2001, 2002, 2003) for k in range(y - 1999) for i in range(2))
    assert 0 < len(got()) <= len(every)
    Pages.broken = ("2003", "3")
    for _ in range(3):
        with contextlib.suppress(Exception):
            run()
    assert "2003/3/0" not in got()
    Pages.broken, Pages.asked = None, []
    for _ in range(3):
        run()
    assert got() == every  # each row once
    assert not any("publication_year:2001" in a for a in Pages.asked)  # what was done isn't asked for again


def test_sinks(spark, tmp_path):
    details = spark.createDataFrame([(1, 0, "A b", "valid", None, "x"), (1, 9, "C d", "outdated", "E f", None)], "doc_id long, idx int, binomial string, type string, suggestion string, common_name string")
    results = spark.createDataFrame([(1, 5, 2), (2, 0, 0)], "doc_id long, candidates_found long, unique_binomials long")
    sinks.write_results(sinks.nested_results(results, details), str(tmp_path / "n"))
    back = {r.doc_id: r for r in spark.read.schema("doc_id long, classifications map<string,long>, details array<struct<binomial:string>>").json(str(tmp_path / "n")).collect()}
    assert back[1].classifications == {"valid": 1, "outdated": 1}
    assert [d.binomial for d in back[1].details] == ["A b", "C d"]
    sinks.write_table(spark.createDataFrame([("Papers", "2")], "metric string, value string"), str(tmp_path / "t"))
    assert "Papers" in next((tmp_path / "t").glob("*.csv")).read_text()



def _corpus(spark):
    """17 papers: one has an outdated name, one is about names not known and doesn't count, the others have a valid name each."""
    names = [(1, 0, "Aa bb", "outdated", "Cc dd", None), (17, 0, "Aa bb", "outdated", "Ee ff", "late"), *((17, 9 * k, f"Xx y{k}", "unknown", None, None) for k in range(1, 6)), *((i, 0, "Cc dd", "valid", None, "the fish") for i in range(2, 17))]
    details = spark.createDataFrame(names, "doc_id long, idx int, binomial string, type string, suggestion string, common_name string")
    docs = spark.createDataFrame([(i,) for i in range(1, 18)], "doc_id long")
    results = corpus.paper_results(docs, details, details)
    known = spark.createDataFrame([(i, f"10/{i}", f"T{i}", 2000, "J") for i in range(1, 18) if i != 3], "doc_id long, doi string, title string, year int, journal string")
    return results, details, known


def test_excluded_papers_do_not_count(spark):
    results, details, known = _corpus(spark)
    assert {r.type: r.n for r in corpus.totals(corpus.included_details(details)).collect()} == {"outdated": 1, "valid": 15}
    assert corpus.included(results).count() == 16
    assert {r.errors: r.papers for r in corpus.histogram(corpus.included(results)).collect()} == {"0": 15, "1": 1, "2": 0, "3+": 0}
    row = corpus.corrections(corpus.included_details(details), details).collect()[0]
    assert (row.binomial, row.n, row.correction, row.common_name) == ("Aa bb", 1, "Ee ff", "late")  # the correction comes from all papers
    s = corpus.summary(results, details, known)
    r = s.collect()[0]
    assert (r.papers, r.excluded, r.with_issues, r.pct_issues, r.species_mentions, r.journals) == (16, 1, 1, 6.2, 16, 2)  # 6.25, a half to the even digit
    assert [(x.doc_id, x.title, x.rounded_ratio) for x in corpus.excluded_papers(results, known).collect()] == [(17, "T17", 0.17)]
    assert [(x.doc_id, x.issues) for x in r.top_papers][:2] == [(1, 1), (2, 0)] and len(r.top_papers) == 10
    assert [(x.journal, x.n) for x in r.top_journals] == [("J", 15), ("Unknown", 1)]
    shown = {m.metric: m.value for m in corpus.metrics(s).collect()}
    assert shown["Papers with naming errors"] == "1 (6.2%)" and shown["Journals represented"] == "2" and "  Misspelled" not in shown
    text = sinks.summary_markdown(s)
    assert "| Outdated | 1 |" in text and "| *Aa bb* | 1 |" in text and "**6.2%**" in text
    none = corpus.summary(results.limit(0), details.limit(0), known).collect()[0]
    assert (none.papers, none.excluded, none.pct_issues) == (0, 0, 0.0)


def test_hundredths_are_pythons(spark):
    pairs = [(n, total) for total in (*range(1, 130), 200, 400, 800, 1600, 99991) for n in range(0, total + 1, max(1, total // 400))]
    rows = spark.createDataFrame(pairs, "n long, total long").select("n", "total", corpus.rounded(F.col("n") / F.col("total"), 100).alias("p")).collect()
    assert all(r.p == round(r.n / r.total, 2) for r in rows)


def test_tenths_are_pythons(spark):
    pairs = [(n, total) for total in (*range(1, 130), 800, 1600, 99991) for n in range(0, total + 1, max(1, total // 90))]
    rows = spark.createDataFrame(pairs, "n long, total long").select("n", "total", corpus.percent(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(r.p == round(r.n / r.total * 100, 1) for r in rows)


def test_caches_and_appends(spark, tmp_path):
    path = str(tmp_path / "c")
    assert files.read_cache(spark, path, "k string, v int", "k").count() == 0
    sinks.append_cache(spark.createDataFrame([("a", 1), ("b", None)], "k string, v int"), path, 1)
    sinks.append_cache(spark.createDataFrame([("a", 2)], "k string, v int"), path, 2)
    assert sorted((r.k, r.v) for r in files.read_cache(spark, path, "k string, v int", "k").collect()) == [("a", 2), ("b", None)]
    items = spark.createDataFrame([(1, 2, 0, "c"), (1, 1, 1, "b"), (1, 1, 0, "a"), (1, 3, 0, None)], "doc long, page int, item int, text string")
    assert files.joined_items(items, "doc").collect()[0].text == "a b\nc\n"
    rows = spark.createDataFrame([(1, True), (2, False), (3, True)], "i int, good boolean")
    sinks.append_valid(rows, F.col("good"), str(tmp_path / "v"), 0)
    sinks.append_valid(rows, F.col("good"), str(tmp_path / "v"), 0)
    ledger = Ledger(spark, str(tmp_path / "v"))
    assert (ledger.read("valid").count(), ledger.read("rejected").count()) == (2, 1)
    sinks.compact_cache(spark, path, "k")
    assert sorted((r.k, r.v) for r in files.read_cache(spark, path, "k string, v int", "k").collect()) == [("a", 2), ("b", None)]
    assert Ledger(spark, path).read("rows").count() == 2


def test_a_commit_that_fails_counts_for_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, good boolean")
    path = str(tmp_path / "v")
    whole, made = Ledger._part, []

    def fails(self, table, df):
        if made:
            raise OSError("no room")
        made.append(table)
        return whole(self, table, df)

    monkeypatch.setattr(Ledger, "_part", fails)
    with pytest.raises(OSError):
        sinks.append_valid(rows, F.col("good"), path, 7)
    monkeypatch.setattr(Ledger, "_part", whole)
    ledger = Ledger(spark, path)
    assert ledger.state()["version"] == 0
    sinks.append_valid(rows, F.col("good"), path, 7)
    sinks.append_valid(rows, F.col("good"), path, 7)
    sinks.append_valid(rows, F.col("good"), path, 8)
    assert (ledger.read("valid").count(), ledger.read("rejected").count()) == (2, 4)
    ledger.compact("valid")
    ledger.clean(keep=1)
    assert len(ledger.state()["tables"]["valid"]["parts"]) == 1
    assert len([p for p in (tmp_path / "v" / "valid").iterdir()]) == 1  # what failed is gone too
    assert (ledger.read("valid").count(), ledger.read("rejected").count()) == (2, 4)


def test_concurrent_commits_both_count(spark, tmp_path, monkeypatch):
    a, b = Ledger(spark, str(tmp_path / "t")), Ledger(spark, str(tmp_path / "t"))
    publish = Ledger._publish

    def after_another(self, state):
        monkeypatch.setattr(Ledger, "_publish", publish)
        assert b.commit("b", 0, {"x": spark.range(3)})  # takes the version that a is about to make
        return publish(self, state)

    monkeypatch.setattr(Ledger, "_publish", after_another)
    assert a.commit("a", 0, {"x": spark.range(2)})
    assert a.read("x").count() == 5 and a.state()["writers"] == {"a": 0, "b": 0}
    assert a.commit("a", 1, replace={"x": spark.range(1)}) and a.read("x").count() == 1


def test_streamed_append(spark, tmp_path):
    spark.createDataFrame([(1, True), (2, False)], "i int, good boolean").write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    query = events.append_valid(stream, F.col("good"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    ledger = Ledger(spark, str(tmp_path / "out"))
    assert [r.i for r in ledger.read("valid").collect()] == [1] and [r.i for r in ledger.read("rejected").collect()] == [2]

"""Queries of corpus aggregation, paper metadata, authority tables, the usage log and sources."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from binomia.functions.shared import new_path, written
from binomia.functions.text import html_text, named_entities
from binomia.operators import catalog, corpus, events, extract, findings, papers, throttle
from binomia.operators.dictionary import first_wins, ordered_distinct
from binomia.plans.q_names import _PARTS, _batch, _parts
from binomia.plans.standin import BATCH_SQL, CLASS_SQL, X4_SQL, dictionary, documents, read, sql, texts
from binomia.sources import files, sinks
from binomia.sources.ledger import Ledger

NOW = "2100-01-01 00:00:00"


def _details(spark, sf, placed=False):
    return _batch(spark, sf, placed)[2]


def _counted(spark, sf):
    return corpus.included_details(_details(spark, sf))


def _papers(spark, sf, placed=False):
    """(results, details) of all papers: texts are read once, names classified once."""
    docs, candidates, details = _batch(spark, sf, placed)
    details = written(details, "details")
    return corpus.paper_results(docs, candidates, details), details


def _results(spark, sf):
    return _papers(spark, sf)[0]


def _known(spark, sf):
    """What is known of papers: English documents' source as their journal."""
    i = F.col("doc_id")
    own = documents(spark, sf).where("lang = 'en'")
    return own.select("doc_id", F.concat(F.lit("10.1/"), i).alias("doi"), F.concat(F.lit("Paper "), i).alias("title"), (F.lit(2000) + i % 20).cast("int").alias("year"), F.col("source").alias("journal"))


def _summary(spark, sf):
    results, details = _papers(spark, sf)
    return corpus.summary(results, details, _known(spark, sf))


def a1_doc_type_counts(spark, sf):
    return corpus.type_counts(_details(spark, sf))


def a2_paper_results(spark, sf):
    return _results(spark, sf)


def a3_corpus_totals(spark, sf):
    return corpus.totals(_counted(spark, sf))


def a4_paper_flags(spark, sf):
    return corpus.paper_flags(corpus.included(_results(spark, sf)))


def a5_top_names(spark, sf):
    return corpus.top_names(_counted(spark, sf)).select("type", F.col("rank").cast("int").alias("rank"), "binomial", "n")


def a6_top_species(spark, sf):
    return corpus.top_species(_counted(spark, sf)).select(F.col("rank").cast("int").alias("rank"), "species", "n")


def a7_journals(spark, sf):
    papers_ = corpus.with_metadata(corpus.included(_results(spark, sf)), _known(spark, sf))
    return corpus.journals(papers_).select(F.col("rank").cast("int").alias("rank"), "journal", "n")


def j10_metadata(spark, sf):
    """Every paper's metadata, or what stands for them."""
    return corpus.with_metadata(_results(spark, sf).select("doc_id", "unique_binomials"), _known(spark, sf))


def a8_issue_papers(spark, sf):
    return corpus.top_papers(corpus.included(_results(spark, sf))).select("doc_id", "issues", "unique_binomials")


def p9_exclusion(spark, sf):
    """Excluded papers with what is known of them (J10, A9)."""
    out = corpus.excluded_papers(_results(spark, sf), _known(spark, sf))
    return out.select("doc_id", "ratio", "rounded_ratio", "unknown", "doi", "title", F.lit("low_na_species_ratio").alias("reason"))


def a10_fig1(spark, sf):
    order = F.array_position(F.array(*map(F.lit, corpus.TYPE_ORDER)), F.col("type"))
    return corpus.totals(_counted(spark, sf)).withColumn("place", order.cast("int")).where("place > 0").select("place", "type", "n")


def a11_fig2(spark, sf):
    return corpus.histogram(corpus.included(_results(spark, sf)))


def a11_fig2_legacy(spark, sf):
    return corpus.histogram(corpus.included(_results(spark, sf)), first=10)


def a12_fig3(spark, sf):
    return corpus.worst_type(_details(spark, sf))


def a13_corrections(spark, sf):
    details = written(_details(spark, sf, placed=True), "details")
    out = corpus.corrections(corpus.included_details(details), details, 10)
    return out.select("type", F.col("rank").cast("int").alias("rank"), "binomial", "n", F.coalesce("correction", F.lit("?")).alias("correction"))


def a14_table1(spark, sf):
    return corpus.metrics(_summary(spark, sf)).select(F.col("place").cast("int").alias("place"), "metric", "value")


def r7_summary(spark, sf):
    """The summary's row, its lists as text, and every excluded paper."""
    (results, details), known = _papers(spark, sf), _known(spark, sf)
    text = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    paper = F.struct("doc_id", F.concat_ws(":", "doc_id", "doi", "title", "unknown").alias("t"))
    listed = corpus.excluded_papers(results, known).agg(F.array_join(F.sort_array(F.collect_list(paper))["t"], ";").alias("excluded_papers"))
    s = corpus.summary(results, details, known).crossJoin(listed)  # one row each
    return s.select(
        "papers", "excluded", *(f"with_{k}" for k in corpus.KINDS), *(f"pct_{k}" for k in corpus.KINDS), "species_mentions", "journals", F.array_join(F.transform(F.map_entries("totals"), lambda e: F.concat_ws(":", e["key"], e["value"])), ";").alias("totals"),
        *(text(c, lambda x: F.concat_ws(":", x["binomial"], x["n"])) for c in ("top_outdated", "top_misspelled", "top_changed")), text("top_species", lambda x: F.concat_ws(":", x["species"], x["n"])), text("top_journals", lambda x: F.concat_ws(":", x["journal"], x["n"])),
        text("top_papers", lambda x: F.concat_ws(":", x["doc_id"], x["title"], x["journal"], x["issues"])), "excluded_papers",
    )


def f16_percent(spark, sf):
    """Shares of all sizes to 64, to one place."""
    total = F.col("c_custkey") % 64 + 1
    rows = read(spark, sf, "customer").select(total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), total)).alias("n")).distinct()
    return rows.select("n", "total", corpus.percent(F.col("n"), F.col("total")).alias("share"))


def k6_table1(spark, sf):
    """The first table, written as CSV and read back."""
    path = new_path(spark, "table1")
    sinks.write_table(corpus.metrics(_summary(spark, sf)).orderBy("place").select(F.col("metric").alias("Metric"), F.col("value").alias("Value")), path)
    return spark.read.schema("Metric string, Value string").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path).select(F.trim("Metric").alias("metric"), F.col("Value").alias("value"))


def k6_table2(spark, sf):
    details, path = written(_details(spark, sf, placed=True), "details"), new_path(spark, "table2")
    rows = corpus.issue_rows(corpus.included_details(details), details).orderBy("type", "rank")
    sinks.write_table(rows.select(F.col("type").alias("Type"), F.col("name_used").alias("Name Used"), F.col("correct_name").alias("Correct Name"), F.col("common_name").alias("Common Name"), F.col("papers").alias("Papers")), path)
    back = spark.read.schema("type string, name_used string, correct_name string, common_name string, papers long").option("header", True).option("enforceSchema", True).csv(path)
    return back.na.fill("")


def k5_summary_json(spark, sf):
    """The summary written as JSON and read back."""
    path = new_path(spark, "summary")
    results, details = _papers(spark, sf)
    known = _known(spark, sf)
    sinks.write_summary(corpus.summary(results, details, known), corpus.excluded_papers(results, known), path)
    back = spark.read.schema("papers long, excluded long, pct_issues double, totals map<string,long>, top_species array<struct<species:string,n:long>>").json(f"{path}/head")
    listed = spark.read.schema("doc_id long, rounded_ratio double").json(f"{path}/excluded").agg(F.count("*").alias("listed"))
    return back.crossJoin(listed).select("papers", "excluded", "pct_issues", F.try_element_at("totals", F.lit("unknown")).alias("unknown"), F.col("top_species")[0]["species"].alias("first_species"), "listed")  # one row each


def k4_results_json(spark, sf):
    """Results a paper as JSON, written and read back (S5)."""
    path = new_path(spark, "results")
    sinks.write_results(sinks.nested_results(*_papers(spark, sf, placed=True)), path)
    back = files.json_dir(spark, path, "doc_id long, candidates_found long, unique_binomials long, classifications map<string,long>, details array<struct<binomial:string,type:string,suggestion:string,commonName:string>>", lines=True)
    return back.select("doc_id", "candidates_found", "unique_binomials", F.coalesce(F.try_element_at("classifications", F.lit("outdated")), F.lit(0)).alias("outdated"), F.coalesce(F.array_join("details.binomial", ";"), F.lit("")).alias("names"))


def f17_known_ratio(spark, sf):
    return corpus.with_exclusion(_results(spark, sf)).select("doc_id", "ratio", "excluded")


def _lines(spark, sf):
    """Lines of a printed list: parts are species rows, 50 a page, under headers by size."""
    p = F.col("p_partkey")
    genus = F.initcap(F.regexp_replace(F.split("p_name", " ").getItem(0), "[^A-Za-z]", ""))
    epithet = F.lower(F.regexp_replace(F.col("p_type"), "[^A-Za-z]", ""))
    flag = F.when(p % 5 == 0, "*").when(p % 7 == 0, "^&").otherwise("")
    row = F.concat(flag, F.when(p % 3 == 0, "\t").otherwise(""), genus, F.lit(" "), epithet, F.when(p % 4 == 0, ",").otherwise(""), F.lit(" (Author, 17"), F.lpad((p % 100).cast("string"), 2, "0"), F.lit(")."), F.lit(" .... "), F.when(p % 11 == 0, "X").when(p % 2 == 0, "A F").otherwise("P"), F.lit(" ..... Common "), p.cast("string"), F.lit(" ... Nombre .... Nom"))
    head = F.when(p % 40 == 1, F.concat(F.lit("CLASS KIND"), F.translate(F.floor(p / 40).cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(" - lampreys"))).when(p % 20 == 2, F.concat(F.lit("ORDER SORT"), F.translate(F.floor(p / 20).cast("string"), "0123456789", "ABCDEFGHIJ"))).when(p % 10 == 3, F.concat(F.lit("Fam"), F.translate(F.floor(p / 10).cast("string"), "0123456789", "abcdefghij"), F.lit("idae - group"))).when(p % 13 == 0, F.lit("NAMES OF FISHES")).when(p % 17 == 0, p.cast("string"))
    each = F.array_compact(F.array(F.when(head.isNotNull(), F.struct(F.lit(0).alias("k"), head.alias("line"))), F.struct(F.lit(1).alias("k"), row.alias("line"))))
    rows = read(spark, sf, "part").select(F.floor((p - 1) / 50).cast("int").alias("page"), p.alias("p"), F.explode(each).alias("l"))
    return rows.select("page", (F.col("p") * 2 + F.col("l.k")).alias("line_no"), F.col("l.line").alias("line"))


def f8_headers(spark, sf):
    return catalog.headers(_lines(spark, sf)).select("page", "line_no", "kind", "name")


def j13_forward_fill(spark, sf):
    return catalog.fill_forward(catalog.headers(_lines(spark, sf))).select("page", "line_no", "tax_class", "tax_order", "tax_family")


def f4_species_lines(spark, sf):
    return catalog.species_lines(_lines(spark, sf)).select("page", "line_no", "genus", "species", "author", "flags", "occurrence", "common_name_en", "common_name_es", "common_name_fr")


def d1_dictionary(spark, sf):
    rows = catalog.species_lines(catalog.fill_forward(catalog.headers(_lines(spark, sf)))).withColumn("binomial", F.concat_ws(" ", "genus", "species"))
    return first_wins(rows, "binomial", "page", "line_no").select("binomial", "page", "line_no", "tax_class", "tax_order", "tax_family", "author", "flags", "occurrence")


def p6_transfers(spark, sf):
    rows = catalog.species_lines(_lines(spark, sf))
    return rows.where(catalog.is_transfer()).groupBy("genus").agg(F.count("*").alias("n"))


def s15_html_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.sha2(html_text(F.col("html")), 256).alias("text_sha256"))


# Catalogue pages: of a part's page a template, with the target {G} {s} and another genus {O}; what each gives stands beside it: status, synonyms, original genera, and (kind, of, epithet, old genus) of its entries.
ENTRIES = (
    ("<p><b>{s}</b>, <i>{O}</i> Author [A. B.] 1891 . Current status: Valid as <i>{G} {s}</i> . Familyidae.</p><p><b>minor</b>, <i>Gamma</i> Writer [J.] 1900 Synonym of {G} {s}</p>", ("true", "{G} {s}"), ("{O} {s}", "Gamma minor"), ("{O}",), (("Valid as", "{G} {s}", "{s}", "{O}"), ("Synonym of", "{G} {s}", "minor", "Gamma"))),
    ("<div>{s}, {O} (Subgenus) Author [C.] 1820 Synonym of Delta {s} &amp; later Synonym of {G} {s}. Current status: Valid as {G} {s}</div>", ("true", "{G} {s}"), ("{O} {s}", "Delta {s}"), ("{O}",), (("Synonym of", "Delta {s}", "{s}", "{O}"), ("Synonym of", "{G} {s}", "{s}", "{O}"), ("Valid as", "{G} {s}", "{s}", "{O}"))),
    ("{s}, {O} Author [J.] 1836 Valid as Delta {s}; Valid as {G} {s}. Current status: Synonym of Other name", ("false", "Other name"), ("{O} {s}", "Delta {s}"), ("{O}",), (("Valid as", "Delta {s}", "{s}", "{O}"), ("Valid as", "{G} {s}", "{s}", "{O}"), ("Synonym of", "Other name", "{s}", "{O}"))),
    ("<p>No entry   , at all</p>", ("false", ""), (), (), ()),
    ("alba, Epsilon old Valid as {G} {s}, Zeta said; alba, Eta new Valid as {G} {s} &#8212; end", ("false", ""), (), ("Epsilon", "Eta"), (("Valid as", "{G} {s}", None, None), ("Valid as", "{G} {s}", None, None))),
    ("sub{s}, {O} Author [J.] 1836; {s}, Kappa&nbsp;Author&#160;[K.] 1840<!-- {s}, Hidden Author [H.] -->", ("false", ""), (), ("{O}", "Kappa"), ()),
)
IDS = ["page_id"]


def _pages(spark, sf):
    p = _parts(spark, sf).select(F.col("p_partkey").alias("page_id"), "genus", F.col("word").alias("species"), F.concat(F.lit("Neo"), F.lower("genus")).alias("other"))
    html = F.array(*(F.lit(e[0]) for e in ENTRIES))[(F.col("page_id") % len(ENTRIES)).cast("int")]
    for name, c in (("{G}", "genus"), ("{s}", "species"), ("{O}", "other")):
        html = F.replace(html, F.lit(name), F.col(c))
    return catalog.page_text(p.withColumn("html", html))


def x8_status(spark, sf):
    return catalog.current_status(_pages(spark, sf), IDS)


def j9_asof_pages(spark, sf):
    """Every status line's nearest header before it."""
    return catalog.entries(_pages(spark, sf), IDS).select("page_id", "kind", "of", "epithet", "old_genus")


def u2_synonyms(spark, sf):
    return catalog.synonyms(_pages(spark, sf), IDS)


def x9_original_genera(spark, sf):
    return catalog.original_genera(_pages(spark, sf), IDS)


def _cache(spark, sf):
    k = F.col("p_partkey")
    name = F.concat_ws(" ", "genus", "word")
    return _parts(spark, sf).select(
        k.alias("ord"), name.alias("binomial"), F.when(k % 7 != 0, k % 2 == 0).alias("valid"), F.when(k % 3 == 0, "").when(k % 3 == 1, name).otherwise(F.concat(F.lit("Neo "), "word")).alias("current_name"),
        F.when(k % 5 == 0, F.array(F.lit("Cc dd"))).otherwise(F.array().cast("array<string>")).alias("synonyms"),
    )


def p7_empty_cache(spark, sf):
    return catalog.is_empty(_cache(spark, sf)).select("ord", "binomial")


def a20_mismatch(spark, sf):
    return catalog.mismatches(_cache(spark, sf))


def k2_cache(spark, sf):
    """A cache of pages written in two parts, the second with a part of the first again, read back; what is left to do is asked for in between (J7, S3)."""
    rows, path = _cache(spark, sf).select("binomial", "valid", "current_name", "synonyms"), new_path(spark, "cache")
    sinks.append_cache(rows.where("length(binomial) % 2 = 0"), path, 1)
    left = papers.remaining(rows, files.read_cache(spark, path, f"binomial string, {files.CACHE}", "binomial"), "binomial")
    sinks.append_cache(left.unionByName(rows.where("length(binomial) % 4 = 0").withColumn("current_name", F.lit("again"))), path, 2)
    return files.read_cache(spark, path, f"binomial string, {files.CACHE}", "binomial").select("binomial", "valid", "current_name", F.array_join("synonyms", ",").alias("synonyms"))


def k3_papers_cache(spark, sf):
    """Papers' states, written as found and again as downloaded, of each the last."""
    found, path = documents(spark, sf).select(F.concat(F.lit("10.1/"), "doc_id").alias("doi"), "doc_id", F.lit("pending").alias("download_status")), new_path(spark, "papers")
    sinks.append_cache(found, path, 1)
    tried = found.where("doc_id % 3 <> 0").withColumn("download_status", papers.next_status(F.col("download_status"), F.col("doc_id") % 3 == 1))
    sinks.append_cache(tried, path, 2)
    sinks.compact_cache(spark, path, "doi")
    return files.read_cache(spark, path, "doi string, doc_id long, download_status string", "doi")


def k1_dictionary_artefact(spark, sf):
    """The printed list with all its fields, written as JSON and read back (S2)."""
    rows = catalog.species_lines(catalog.fill_forward(catalog.headers(_lines(spark, sf)))).withColumn("binomial", F.concat_ws(" ", "genus", "species"))
    names = first_wins(rows, "binomial", "page", "line_no").withColumn("ord", F.col("line_no"))
    synonyms, path = names.select("ord", F.concat(F.lit("Neo "), "species").alias("old_name"), F.col("binomial").alias("new_name")).where("ord % 4 = 1"), new_path(spark, "dictionary")
    sinks.write_json(sinks.authority_frame(names, first_wins(synonyms, "old_name", "ord"), 8, 2023, "list"), path)
    back = spark.read.schema(files.DICTIONARY).json(path)
    out = back.select(F.explode("valid_names").alias("binomial", "v"), "metadata.species_count", F.size("genera").cast("int").alias("genera"))
    return out.select("binomial", F.col("v.class").alias("tax_class"), F.col("v.order").alias("tax_order"), F.col("v.family").alias("tax_family"), "v.author", "v.occurrence", "v.flags", "v.common_name_en", "v.common_name_es", "v.common_name_fr", "species_count", "genera")


def s2_dictionary_json(spark, sf):
    """The printed list written as its artefact, and read back as a dictionary of names, synonyms, genera and common names."""
    rows = catalog.species_lines(catalog.fill_forward(catalog.headers(_lines(spark, sf)))).withColumn("binomial", F.concat_ws(" ", "genus", "species"))
    names = first_wins(rows, "binomial", "page", "line_no").withColumn("ord", F.col("line_no"))
    synonyms, path = names.select("ord", F.concat(F.lit("Neo "), "species").alias("old_name"), F.col("binomial").alias("new_name")).where("ord % 4 = 1"), new_path(spark, "dictionary")
    sinks.write_json(sinks.authority_frame(names, first_wins(synonyms, "old_name", "ord"), 8, 2023, "list"), path)
    d, meta = files.dictionary_json(spark, path)
    out = d.valid.join(d.common.select(F.col("binomial").alias("_of"), F.col("l_name").alias("known_as")), F.col("binomial") == F.col("_of"), "left").select(F.lit("name").alias("kind"), F.col("binomial").alias("name"), "flags", F.coalesce("known_as", F.lit("")).alias("of"))
    out = out.unionByName(d.synonyms.select(F.lit("synonym").alias("kind"), F.col("old_name").alias("name"), F.lit("").alias("flags"), F.col("new_name").alias("of")))
    out = out.unionByName(d.genera.select(F.lit("genus").alias("kind"), F.col("l_genus").alias("name"), F.lit("").alias("flags"), F.lit("").alias("of")))
    return out.unionByName(meta.select(F.lit("metadata").alias("kind"), F.col("source").alias("name"), F.col("edition").cast("string").alias("flags"), F.col("year").cast("string").alias("of")))


def s1_text_lines(spark, sf):
    """Pages of the list as text files, read as lines; blank ones are left out."""
    path = new_path(spark, "lines")
    pages = _lines(spark, sf).groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n\n").alias("value"))
    pages.write.partitionBy("page").text(path)
    return files.text_lines(spark, f"{path}/page=*").groupBy("line").agg(F.count("*").alias("n"))


def s4_text_dir(spark, sf):
    """Benchmark items, a text file each, read whole."""
    path = new_path(spark, "texts")
    read(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    return files.text_dir(spark, f"{path}/item_id=*").select(F.sha2(F.rtrim("text", F.lit("\n")), 256).alias("text_sha256")).groupBy("text_sha256").agg(F.count("*").alias("n"))


def s3_or_empty(spark, sf):
    """A table that is not there yet, beside one that is."""
    some = files.or_empty(spark, f"{sf}/labels.parquet", "doc_id long, quality int").select("doc_id")
    return some.unionByName(files.or_empty(spark, f"{new_path(spark, 'none')}", "doc_id long")).agg(F.count("*").alias("n"))


def s13_joined_items(spark, sf):
    """Words of a conversation's turns as items of pages."""
    items = read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("item", "text"))
    return files.joined_items(items, "conv_id", "turn", "item").select("conv_id", F.sha2("text", 256).alias("text_sha256"))


def k10_pdf_magic(spark, sf):
    """Downloads that are PDF files by their first bytes, or by the content type that came with them."""
    body = F.concat(F.when(F.col("page_id") % 3 == 0, "%PDF-1.7 ").when(F.col("page_id") % 3 == 1, "%pdf").otherwise(""), "html").cast("binary")
    said = F.when(F.col("page_id") % 5 == 0, "Application/PDF; qs=0.1").when(F.col("page_id") % 5 == 1, "text/html")
    rows = read(spark, sf, "pages").select("page_id", body.alias("content"), said.alias("content_type"))
    return rows.where(papers.is_pdf(F.col("content"), F.col("content_type"))).select("page_id", F.length("content").cast("long").alias("size"))


def k9_append(spark, sf):
    """Visits appended to a table in two commits, those not valid to another; the first commit is tried again, as after a lost answer."""
    path = new_path(spark, "visits")
    v, ok = _visits(spark, sf), events.valid_visit(F.lit(NOW).cast("timestamp"))
    for half in (0, 0, 1):
        sinks.append_valid(v.where(F.col("event_id") % 2 == half), ok, path, half)
    count = lambda p, to: Ledger(spark, path).read(p).groupBy("country").agg(F.count("*").alias("n")).withColumn("table", F.lit(to))
    return count("valid", "visits").unionByName(count("rejected", "rejected"))


def f11_doi(spark, sf):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://doi.org/10."), F.col("page_id"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("10."), F.col("page_id")))
    return read(spark, sf, "pages").select("page_id", papers.doi(raw).alias("doi")).where("doi is not null")


def f12_hash(spark, sf):
    return read(spark, sf, "pages").select("page_id", papers.file_hash(F.col("url")).alias("file_hash"))


# Addresses by page, {n} its number: hosts that are rewritten, and others.
URLS = (
    ("https://onlinelibrary.wiley.com/doi/10.1111/abc{n}?x=1", "10.1111/abc{n}"), ("https://www.mdpi.com/1/2/{n}/", "10.3390/x{n}"), ("https://academic.oup.com/a/b{n}", None), ("https://link.springer.com/article/10.1007/s{n}", "10.1007/s{n}"),
    ("https://www.frontiersin.org/articles/{n}/pdf", "10.3389/f"), ("", "10.1/z{n}"), ("https://doi.org/10.1/z{n}", "10.1/z{n}"), (None, None), ("https://host/x{n}.pdf", "10.2/y{n}"),
)


def f13_url_candidates(spark, sf):
    at, n = (F.col("page_id") % len(URLS)).cast("int"), F.col("page_id").cast("string")
    of = lambda k: F.replace(F.array(*(F.lit(u[k]).cast("string") for u in URLS))[at], F.lit("{n}"), n)
    return read(spark, sf, "pages").select("page_id", F.posexplode(papers.url_candidates(of(0), of(1))).alias("attempt", "candidate"))


def f13_page_urls(spark, sf):
    rows = read(spark, sf, "pages").select("page_id", papers.url_candidates(F.col("url"), F.concat(F.lit("10.5/"), F.col("page_id"))).alias("c"))
    return rows.select("page_id", F.posexplode("c").alias("attempt", "candidate"))


WORKS = "struct<id:string,doi:string,title:string,publication_year:int,cited_by_count:int,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>>,open_access:struct<oa_url:string>>"


def f14_papers(spark, sf):
    """API rows made from documents: F11, F14, F15, F18 and D4 together."""
    i = F.col("doc_id")
    names = F.transform(F.sequence(F.lit(1), (i % 13 + 1).cast("int")), lambda k: F.struct(F.struct(F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("A"), k.cast("string"))).alias("display_name")).alias("author")))
    title = F.when(i % 6 == 0, "Stream Fish assemblage of X").when(i % 6 == 1, "Fish species and aquaculture").when(i % 6 == 2, "Reef fish of Y").when(i % 6 == 3, "Ichthyofauna: a review").when(i % 6 == 4, None).otherwise("Birds")
    works = documents(spark, sf).select(
        F.concat(F.lit("W"), i).alias("id"), F.when(i % 10 != 9, F.concat(F.lit("https://doi.org/10.1/"), F.floor(i / 2))).alias("doi"), title.alias("title"), (F.lit(2000) + i % 20).cast("int").alias("publication_year"), F.col("n_chars").cast("int").alias("cited_by_count"),
        names.alias("authorships"), F.when(i % 4 != 0, F.struct(F.struct(F.col("source").alias("display_name")).alias("source"))).alias("primary_location"), F.struct(F.when(i % 5 != 0, F.concat(F.lit("https://host/"), i)).alias("oa_url")).alias("open_access"),
    )
    return first_wins(papers.papers(works), "doi", "work_id").select("doi", "title", F.array_join("authors", ";").alias("authors"), "year", "journal", "oa_url", "cited_by_count", "work_id", "download_status")


TITLES = (("the ", " of", "der"), ("heat", "ion the"))


def f18_title_filter(spark, sf):
    """Whole texts as titles, by lists of words that they have."""
    return documents(spark, sf).where(papers.relevant(F.col("text"), *TITLES)).select("doc_id")


def f18_title_lists(spark, sf):
    """Titles made of the words that make a paper relevant, some cut short, some with a word that excludes it; every word of both lists comes."""
    i, pick = F.col("doc_id"), lambda words, of: F.element_at(F.array(*map(F.lit, words)), (of % len(words) + 1).cast("int"))
    wanted = pick(papers.TITLE_INCLUDE, i)
    wanted = F.when(i % 7 == 1, F.left(wanted, F.length(wanted) - 1)).when(i % 7 == 2, F.upper(wanted)).otherwise(wanted)
    title = F.concat(F.lit("Notes on "), wanted, F.lit(" of a lake"), F.when(i % 3 == 0, F.concat(F.lit(": "), pick(papers.TITLE_EXCLUDE, F.floor(i / 3)))).otherwise(""))
    return documents(spark, sf).select("doc_id", title.alias("title")).where(papers.relevant(F.col("title"))).select("doc_id", "title")


def d4_dedupe(spark, sf):
    return first_wins(documents(spark, sf).select("doc_id", "source", "lang"), "source", "doc_id")


def f23_usable_text(spark, sf):
    return documents(spark, sf).groupBy(papers.usable_text(F.col("text")).alias("usable")).agg(F.count("*").alias("n"))


def s10_joined_pages(spark, sf):
    """Turns of a conversation as pages of a text: those that aren't blank, joined by a blank line."""
    return files.joined_pages(read(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", F.sha2("text", 256).alias("text_sha256"))


def j7_remaining(spark, sf):
    return papers.remaining(documents(spark, sf), read(spark, sf, "labels"), "doc_id").select("doc_id", "source")


def l1_limit(spark, sf):
    return read(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500).select("o_orderkey", "o_custkey")


def e7_status_machine(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "pending").otherwise("downloaded")
    rows = read(spark, sf, "orders").select(status.alias("status"), (F.col("o_totalprice") > 100000).alias("ok"))
    return rows.groupBy("status", papers.next_status(F.col("status"), F.col("ok"), retry=True).alias("next")).agg(F.count("*").alias("n"))


def _visits(spark, sf):
    return visits_of(read(spark, sf, "events"))


def visits_of(rows):
    """Events as visits with a place."""
    k = F.get_json_object("props", "$.k").cast("double")
    return rows.select(
        "event_id", "user_id", "ts", (k - 50).alias("lat"), (F.col("value") % 400 - 200).alias("lng"), F.when(F.col("user_id") % 9 == 0, "").otherwise(F.concat(F.lit("C"), F.col("user_id") % 7)).alias("country"),
        F.when(F.col("event_id") % 97 == 0, F.rpad(F.lit("x"), 101, "x")).otherwise(F.col("event_type")).alias("city"), k.cast("long").alias("k"), F.date_trunc("day", "ts").alias("session"),
    )


def p13_event_validation(spark, sf):
    """Visits by whether they are valid; one with a field of its own isn't."""
    v = _visits(spark, sf).select(*events.VISIT, F.when(F.col("event_id") % 50 == 0, "x").alias("extra"))
    ok = events.valid_visit(F.lit(NOW).cast("timestamp")) & events.no_others(v.columns, events.VISIT)
    return v.groupBy("country", ok.alias("valid")).agg(F.count("*").alias("n"))


def p13_issue_validation(spark, sf):
    """Documents as issues, with their first line as the title and the whole text as the body."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    rows = documents(spark, sf).select("doc_id", F.when(i % 10 != 0, F.col("lang")).alias("type"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), none.alias("email"), none.alias("ua"), F.lit(NOW).cast("timestamp").alias("ts"))
    return rows.select("doc_id", events.valid_issue(F.lit(NOW).cast("timestamp")).alias("valid"))


def a17_dashboard(spark, sf):
    v = _visits(spark, sf)
    return events.dashboard(v, F.col("k") * 10)


def s14_last_visits(spark, sf):
    return events.last_visits(_visits(spark, sf)).select("event_id", "user_id")


def p12_markers(spark, sf):
    return _visits(spark, sf).where("lat <> 0 and lng <> 0").groupBy(events.location().alias("place")).agg(F.count("*").alias("n"))


def e1_session_dedupe(spark, sf):
    return events.once_a_session(_visits(spark, sf)).select("user_id", "session", "event_id")


def e2_rate_limit(spark, sf):
    return throttle.rate_limited(_visits(spark, sf), 3600.0).groupBy("user_id").agg(F.count("*").alias("accepted"), F.sum("event_id").alias("event_ids"))


def e5_counters(spark, sf):
    return events.counters(_visits(spark, sf), F.col("k") * 10)


def s9_oa_lookup(spark, sf):
    places = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("url_for_pdf"))
    return papers.with_location(documents(spark, sf).select("doc_id"), places, "doc_id")


def l2_usable_limit(spark, sf):
    rows = documents(spark, sf).withColumns({"download_status": F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("downloaded"), "pdf_file": papers.file_hash(F.col("doc_id").cast("string"))})
    return papers.first_usable(papers.downloaded(rows), papers.usable_text(F.col("text")), 115, "doc_id").select("doc_id", "pdf_file")


def a19_acceptance(spark, sf):
    return papers.acceptance(documents(spark, sf), papers.relevant(F.col("text"), *TITLES), "lang")


def d6_ordered_distinct(spark, sf):
    return ordered_distinct(documents(spark, sf), "source", "doc_id", "lang").select("source", F.array_join("values", ",").alias("langs"))


def j14_empty_transfers(spark, sf):
    rows = catalog.species_lines(catalog.fill_forward(catalog.headers(_lines(spark, sf)))).withColumn("binomial", F.concat_ws(" ", "genus", "species"))
    names = first_wins(rows, "binomial", "page", "line_no").select("binomial", "author", "tax_family", F.col("line_no"))
    cache = names.select("binomial", F.when(F.col("line_no") % 5 == 0, None).otherwise(F.lit(False)).alias("valid"), F.when(F.col("line_no") % 3 == 0, "Xx yy").otherwise("").alias("current_name"), F.array().cast("array<string>").alias("synonyms"))
    return catalog.empty_transfers(cache, names.drop("line_no"))


def e3_consent(spark, sf):
    v = _visits(spark, sf).withColumn("consent", F.when(F.col("user_id") % 3 == 0, True).when(F.col("user_id") % 3 == 1, False))
    return events.consented(v).groupBy("user_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    s9_oa_lookup, l2_usable_limit, a19_acceptance, d6_ordered_distinct, j14_empty_transfers, e3_consent,
    a1_doc_type_counts, a2_paper_results, a3_corpus_totals, a4_paper_flags, a5_top_names, a6_top_species, a7_journals, a8_issue_papers, p9_exclusion, a10_fig1, a11_fig2, a11_fig2_legacy, a12_fig3, a13_corrections, a14_table1, f17_known_ratio,
    f8_headers, j13_forward_fill, f4_species_lines, d1_dictionary, p6_transfers, s15_html_text, x8_status, u2_synonyms, x9_original_genera, j9_asof_pages, r7_summary, f16_percent, j10_metadata, k1_dictionary_artefact, k2_cache, k3_papers_cache, k4_results_json, k5_summary_json, k6_table1, k6_table2, k9_append, k10_pdf_magic, s1_text_lines, s2_dictionary_json, s3_or_empty, s4_text_dir, s13_joined_items, p7_empty_cache, a20_mismatch, f11_doi, f12_hash, f13_url_candidates, f13_page_urls,
    f14_papers, f18_title_filter, f18_title_lists, d4_dedupe, f23_usable_text, s10_joined_pages, j7_remaining, l1_limit, e7_status_machine, p13_event_validation, p13_issue_validation, a17_dashboard, s14_last_visits, p12_markers, e1_session_dedupe, e2_rate_limit, e5_counters,
)}

_B = (X4_SQL, CLASS_SQL, BATCH_SQL)
_SPECIES = "sp AS (SELECT *, coalesce(suggestion, binomial) AS species FROM {} WHERE type IN ('misspelled', 'outdated', 'changed', 'valid'))"
_KNOWN = """known AS (SELECT doc_id, '10.1/' || doc_id AS doi, 'Paper ' || doc_id AS title, (2000 + doc_id % 20)::INTEGER AS year, source AS journal FROM documents WHERE lang = 'en'),
meta AS (SELECT r.doc_id, unique_binomials, coalesce(doi, '') AS doi, coalesce(title, 'Unknown') AS title, coalesce(year, 0) AS year, coalesce(journal, 'Unknown') AS journal FROM results r LEFT JOIN known USING (doc_id))"""
_LAST = "fix AS (SELECT binomial, max_by(suggestion, (doc_id, idx)) AS correction, max_by(common_name, (doc_id, idx)) FILTER (common_name <> '') AS common_name FROM batch WHERE type IN ('outdated', 'misspelled') AND suggestion <> '' GROUP BY 1)"
_TOP = "tops AS MATERIALIZED (SELECT type, binomial, n, row_number() OVER (PARTITION BY type ORDER BY n DESC, binomial)::INTEGER AS rank FROM (SELECT type, binomial, count(*) AS n FROM ib WHERE type IN ('outdated', 'misspelled', 'changed') GROUP BY 1, 2))"
_PCT = lambda n: f"CASE WHEN p = 0 THEN 0.0 ELSE CAST(printf('%.1f', {n} / p * 100) AS DOUBLE) END"
_FLAGS = f"""flags AS MATERIALIZED (SELECT *, {_PCT("i")} AS pi, {_PCT("o")} AS po, {_PCT("m")} AS pm, {_PCT("c")} AS pc, {_PCT("u")} AS pu FROM (SELECT count(*) AS p, count(*) FILTER (issues > 0) AS i, count(*) FILTER (outdated > 0) AS o, count(*) FILTER (misspelled > 0) AS m,
  count(*) FILTER (changed > 0) AS c, count(*) FILTER (unknown > 0) AS u, coalesce(sum(unique_binomials), 0)::BIGINT AS mentions, (SELECT count(*) FROM ratios) - count(*) AS excluded, (SELECT count(DISTINCT journal) FROM meta JOIN inc USING (doc_id)) AS journals FROM inc))"""
_SHOWN = lambda n: f"{n} || ' (' || CASE WHEN p = 0 THEN '0' ELSE p{n}::VARCHAR END || '%)'"
_TABLE1 = f"""t1 AS (SELECT unnest(range(15))::INTEGER AS place, unnest(['Papers analyzed', 'Papers excluded (non-NA)', 'Papers with naming errors', '  with outdated names', '  with misspelled names', 'Papers with changed names (8th ed.)', 'Papers with unknown names', 'Total unique species detected', 'Journals represented',
   '  Valid', '  Changed (8th ed.)', '  Common Name', '  Outdated Synonym', '  Misspelled', '  Unknown (not in AFS)']) AS metric,
  unnest([p::VARCHAR, excluded::VARCHAR, {_SHOWN("i")}, {_SHOWN("o")}, {_SHOWN("m")}, {_SHOWN("c")}, {_SHOWN("u")}, mentions::VARCHAR, journals::VARCHAR, t['valid'], t['changed'], t['common_name'], t['outdated'], t['misspelled'], t['unknown']]) AS value
  FROM flags, (SELECT coalesce(map_from_entries(list((type, n::VARCHAR))), MAP {{}}) AS t FROM (SELECT type, count(*) AS n FROM ib GROUP BY 1)))"""
_LINES = r"""lines AS MATERIALIZED (SELECT CAST(floor((p - 1) / 50) AS INTEGER) AS page, p * 2 + k AS line_no, line FROM (
 SELECT p_partkey AS p, 1 AS k, CASE WHEN p_partkey % 5 = 0 THEN '*' WHEN p_partkey % 7 = 0 THEN '^&' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN chr(9) ELSE '' END
  || upper(g[1]) || lower(g[2:]) || ' ' || lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) || CASE WHEN p_partkey % 4 = 0 THEN ',' ELSE '' END || ' (Author, 17' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || ').' || ' .... '
  || CASE WHEN p_partkey % 11 = 0 THEN 'X' WHEN p_partkey % 2 = 0 THEN 'A F' ELSE 'P' END || ' ..... Common ' || p_partkey || ' ... Nombre .... Nom' AS line
 FROM (SELECT *, regexp_replace(split_part(p_name, ' ', 1), '[^A-Za-z]', '', 'g') AS g FROM part)
 UNION ALL
 SELECT p_partkey, 0, CASE WHEN p_partkey % 40 = 1 THEN 'CLASS KIND' || translate(CAST(p_partkey // 40 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || ' - lampreys'
  WHEN p_partkey % 20 = 2 THEN 'ORDER SORT' || translate(CAST(p_partkey // 20 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') WHEN p_partkey % 10 = 3 THEN 'Fam' || translate(CAST(p_partkey // 10 AS VARCHAR), '0123456789', 'abcdefghij') || 'idae - group'
  WHEN p_partkey % 13 = 0 THEN 'NAMES OF FISHES' WHEN p_partkey % 17 = 0 THEN CAST(p_partkey AS VARCHAR) END FROM part) WHERE line IS NOT NULL),
kinds AS MATERIALIZED (SELECT *, CASE WHEN line = 'NAMES OF FISHES' OR regexp_full_match(line, '[0-9]+') THEN 'skip' WHEN line LIKE 'CLASS %' THEN 'class' WHEN line LIKE 'ORDER %' THEN 'order' WHEN regexp_matches(line, '^Fam[a-z]*idae') THEN 'family'
  WHEN line LIKE '%....%' THEN 'species' ELSE 'other' END AS kind,
  CASE WHEN line LIKE 'CLASS %' THEN 'K' || lower(substr(regexp_extract(line, '^CLASS ([A-Z]+)', 1), 2)) WHEN line LIKE 'ORDER %' THEN 'S' || lower(substr(regexp_extract(line, '^ORDER ([A-Z]+)', 1), 2)) WHEN line LIKE 'Fam%idae - group' THEN split_part(line, ' ', 1) END AS name FROM lines),
filled AS MATERIALIZED (SELECT * FROM (SELECT *, coalesce(last_value(CASE WHEN kind = 'class' THEN name END IGNORE NULLS) OVER w, '') AS tax_class, coalesce(last_value(CASE WHEN kind = 'order' THEN name END IGNORE NULLS) OVER w, '') AS tax_order,
  coalesce(last_value(CASE WHEN kind = 'family' THEN name END IGNORE NULLS) OVER w, '') AS tax_family FROM kinds WINDOW w AS (ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE kind = 'species'),
cells AS MATERIALIZED (SELECT *, regexp_replace(ltrim(c[1], chr(9) || ' '), '^[*^&+]+\s*', '') AS rest, regexp_extract(ltrim(c[1], chr(9) || ' '), '^([*^&+]+)', 1) AS flags, regexp_replace(trim(c[2]), '\s+', '', 'g') AS occurrence FROM (SELECT *, string_split_regex(line, '\.{2,}') AS c FROM filled)),
species AS MATERIALIZED (SELECT *, t[1] AS genus, rtrim(t[2], '.,') AS species, trim(array_to_string(t[3:], ' '), '.,') AS author, trim(c[3]) AS common_name_en, trim(coalesce(c[4], '')) AS common_name_es, trim(coalesce(c[5], '')) AS common_name_fr
  FROM (SELECT *, string_split_regex(trim(rest), '\s+') AS t FROM cells) WHERE regexp_matches(occurrence, '^[APFarCMU]') AND len(t) >= 3 AND regexp_full_match(t[1], '[A-Z][a-z]+') AND regexp_full_match(rtrim(t[2], '.,'), '[a-z][a-z-]{2,}'))"""
_ENTITY = "&(?:#[0-9]{1,7};?|#[xX][0-9A-Fa-f]{1,6};?|[A-Za-z][A-Za-z0-9]*;?)"
_NUMBER = "CASE WHEN e[3] IN ('x', 'X') THEN ('0x' || regexp_extract(e, '([0-9A-Fa-f]+)', 1))::INTEGER ELSE regexp_extract(e, '([0-9]+)', 1)::INTEGER END"
_NAMED = "coalesce(json_extract_string(names, '$.\"' || e[2:] || '\"'), json_extract_string(names, '$.\"' || e[2:] || ';\"'))"
_CHAR = f"coalesce(CASE WHEN e[2] = '#' THEN CASE WHEN {_NUMBER} BETWEEN 1 AND 127 OR {_NUMBER} BETWEEN 160 AND 55295 OR {_NUMBER} BETWEEN 57344 AND 1114111 THEN chr({_NUMBER}) ELSE json_extract_string(names, '$.\"#' || {_NUMBER} || '\"') END ELSE {_NAMED} END, e)"
_BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NAMES = json.dumps({k: v for some in json.loads(named_entities()).values() for k, v in some.items()}).replace("'", "''")
_HTML = f"""ents AS MATERIALIZED (SELECT '{_NAMES}'::JSON AS names), bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<template\\b.*?</template\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
found AS (SELECT DISTINCT unnest(regexp_extract_all(t, '{_ENTITY}')) AS e FROM bare), chars AS (SELECT map_from_entries(list((e, {_CHAR}))) AS m FROM found, ents),
shown AS (SELECT page_id, regexp_replace(regexp_replace(array_to_string(list_transform(list_zip(string_split_regex(t, '{_ENTITY}'), regexp_extract_all(t, '{_ENTITY}')), lambda x: x[1] || coalesce(m[x[2]], '')), ''), '{_BLANK}+', ' ', 'g'), ' +,', ',', 'g') AS t FROM bare, chars)"""
_VISITS = """v AS MATERIALIZED (SELECT event_id, user_id, ts, k - 50 AS lat, value % 400 - 200 AS lng, CASE WHEN user_id % 9 = 0 THEN '' ELSE 'C' || (user_id % 7) END AS country,
 CASE WHEN event_id % 97 = 0 THEN repeat('x', 101) ELSE event_type END AS city, CAST(k AS BIGINT) AS k, date_trunc('day', ts) AS session FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""
_VALID = f"coalesce(lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND length(country) <= 100 AND length(city) <= 100 AND ts <= TIMESTAMP '{NOW}', false)"
_CACHE = """cache AS (SELECT p_partkey AS ord, genus || ' ' || word AS binomial, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 2 = 0 END AS valid, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN genus || ' ' || word ELSE 'Neo ' || word END AS current_name,
  CASE WHEN p_partkey % 5 = 0 THEN ['Cc dd'] ELSE [] END AS synonyms FROM parts)"""


def _by_entry(rows, *columns: str) -> str:
    """What each page's template gives, with its names put in."""
    name = lambda c: f"replace(replace(replace({c}, '{{G}}', genus), '{{s}}', word), '{{O}}', 'Neo' || lower(genus)) AS {c}"
    values = ", ".join(_SQL_ROW((k, *r)) for k, e in enumerate(ENTRIES) for r in rows(e))
    return f"WITH {_PARTS} SELECT page_id, {', '.join(columns)} FROM (SELECT p_partkey AS page_id, {', '.join(map(name, columns))} FROM parts JOIN (VALUES {values}) t(k, {', '.join(columns)}) ON k = p_partkey % {len(ENTRIES)})"


_PLACE = "concat_ws(', ', nullif(city, ''), nullif(country, ''))"


def _urls(url: str, doi: str) -> str:
    """Candidates in order, as a list."""
    rewritten = f"""list_filter([CASE WHEN contains({url}, 'onlinelibrary.wiley.com') AND regexp_matches({url}, '/doi/10\\.[0-9]{{4,}}/[^\\s?#]+') THEN 'https://onlinelibrary.wiley.com/doi/pdfdirect/' || regexp_extract({url}, '/doi/(10\\.[0-9]{{4,}}/[^\\s?#]+)', 1) || '?download=true' END,
  CASE WHEN contains({url}, 'mdpi.com') AND NOT contains({url}, '/pdf') THEN rtrim({url}, '/') || '/pdf' END, CASE WHEN contains({url}, 'academic.oup.com') AND NOT contains({url}, '/pdf') THEN rtrim({url}, '/') || '/pdf' END,
  CASE WHEN contains({url}, 'link.springer.com/article') AND NOT contains({url}, '.pdf') THEN replace({url}, '/article/', '/content/pdf/') || '.pdf' END, CASE WHEN contains({url}, 'frontiersin.org') AND NOT contains({url}, '/pdf') THEN rtrim({url}, '/') || '/pdf' END], lambda x: x IS NOT NULL)"""
    tried = f"({rewritten} || CASE WHEN len({rewritten}) = 0 AND coalesce({doi}, '') <> '' AND {url} <> 'https://doi.org/' || {doi} THEN ['https://doi.org/' || {doi}] ELSE [] END)"
    return f"CASE WHEN {url} <> '' AND NOT list_contains({tried}, {url}) THEN {tried} || [{url}] ELSE {tried} END"


_URLS = "SELECT id, unnest(range(len(c)))::INTEGER AS attempt, unnest(c) AS candidate FROM (SELECT id, " + _urls("url", "doi") + " AS c FROM (SELECT id, coalesce(url, '') AS url, doi FROM ({})))"
_SQL_ROW = lambda r: "(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")"

ORACLES = {
    "s9_oa_lookup": "SELECT d.doc_id, CASE WHEN page_id % 3 <> 0 THEN url END AS url_for_pdf FROM documents d LEFT JOIN pages ON page_id = d.doc_id",
    "l2_usable_limit": "SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS pdf_file FROM documents WHERE doc_id % 4 <> 0 AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 100 ORDER BY doc_id LIMIT 115",
    "a19_acceptance": "SELECT lang, count(*) AS seen, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok) / count(*) AS rate FROM (SELECT lang, NOT (contains(t, 'heat') OR contains(t, 'ion the')) AND (contains(t, 'the ') OR contains(t, ' of') OR contains(t, 'der')) AS ok FROM (SELECT lang, lower(text) AS t FROM documents)) GROUP BY lang",
    "d6_ordered_distinct": "SELECT source, string_agg(lang, ',' ORDER BY a) AS langs FROM (SELECT source, lang, min(doc_id) AS a FROM documents GROUP BY 1, 2) GROUP BY 1",
    "j14_empty_transfers": f"WITH {_LINES} SELECT binomial, author, tax_family FROM (SELECT *, genus || ' ' || species AS binomial FROM species QUALIFY row_number() OVER (PARTITION BY genus || ' ' || species ORDER BY page, line_no) = 1) WHERE line_no % 5 <> 0 AND line_no % 3 <> 0 AND starts_with(author, '(')",
    "e3_consent": f"WITH {_VISITS} SELECT user_id, count(*) AS n FROM v WHERE user_id % 3 = 0 GROUP BY 1",
    "a1_doc_type_counts": sql("SELECT doc_id, type, count(*) AS n FROM batch GROUP BY 1, 2", *_B),
    "a2_paper_results": sql("SELECT * FROM results", *_B),
    "a3_corpus_totals": sql("SELECT type, count(*) AS n FROM ib GROUP BY 1", *_B),
    "a4_paper_flags": sql("SELECT count(*) AS papers, count(*) FILTER (issues > 0) AS with_issues, count(*) FILTER (outdated > 0) AS with_outdated, count(*) FILTER (misspelled > 0) AS with_misspelled, count(*) FILTER (changed > 0) AS with_changed, count(*) FILTER (unknown > 0) AS with_unknown FROM inc", *_B),
    "a5_top_names": sql("SELECT type, rank, binomial, n FROM tops WHERE rank <= 20", *_B, _TOP),
    "a6_top_species": sql("SELECT row_number() OVER (ORDER BY n DESC, species)::INTEGER AS rank, species, n FROM (SELECT species, count(*) AS n FROM sp GROUP BY 1) ORDER BY n DESC, species LIMIT 30", *_B, _SPECIES.format("ib")),
    "a7_journals": sql("SELECT row_number() OVER (ORDER BY n DESC, journal)::INTEGER AS rank, journal, n FROM (SELECT journal, count(*) AS n FROM meta JOIN inc USING (doc_id) GROUP BY 1) ORDER BY n DESC, journal LIMIT 15", *_B, _KNOWN),
    "a8_issue_papers": sql("SELECT doc_id, issues, unique_binomials FROM inc ORDER BY issues DESC, doc_id LIMIT 10", *_B),
    "j10_metadata": sql("SELECT * FROM meta", *_B, _KNOWN),
    "p9_exclusion": sql("SELECT doc_id, ratio, CAST(printf('%.2f', ratio) AS DOUBLE) AS rounded_ratio, unknown, doi, title, 'low_na_species_ratio' AS reason FROM ratios JOIN meta USING (doc_id) WHERE ratio < 0.3 AND unknown > 3", *_B, _KNOWN),
    "a10_fig1": sql("SELECT list_position(['valid', 'changed', 'common_name', 'outdated', 'misspelled', 'unknown'], type)::INTEGER AS place, type, count(*) AS n FROM ib WHERE type IN ('valid', 'changed', 'common_name', 'outdated', 'misspelled', 'unknown') GROUP BY type", *_B),
    "a11_fig2": sql("SELECT errors, count(issues) AS papers FROM (VALUES ('0', 0, 0), ('1', 1, 1), ('2', 2, 2), ('3+', 3, 1000000000)) t(errors, least, most) LEFT JOIN inc ON issues BETWEEN least AND most GROUP BY 1", *_B),
    "a11_fig2_legacy": sql("SELECT errors, count(i) AS papers FROM (VALUES ('0', 0, 0), ('1', 1, 1), ('2', 2, 2), ('3+', 3, 1000000000)) t(errors, least, most) LEFT JOIN (SELECT CASE WHEN issues = 0 THEN 0 WHEN row_number() OVER (ORDER BY issues DESC, doc_id) <= 10 THEN issues ELSE 1 END AS i FROM inc) ON i BETWEEN least AND most GROUP BY 1", *_B),
    "a12_fig3": sql("SELECT species, count(*) AS n, min_by(type, list_position(['misspelled', 'outdated', 'changed', 'valid'], type)) AS worst FROM sp GROUP BY 1 ORDER BY n DESC, species LIMIT 20", *_B, _SPECIES.format("batch")),
    "a13_corrections": sql("SELECT type, rank, binomial, n, coalesce(correction, '?') AS correction FROM tops LEFT JOIN fix USING (binomial) WHERE rank <= 10 AND type <> 'changed'", *_B, _TOP, _LAST),
    "a14_table1": sql("SELECT place, metric, value FROM t1 WHERE value IS NOT NULL", *_B, _KNOWN, _FLAGS, _TABLE1),
    "k6_table1": sql("SELECT trim(metric) AS metric, value FROM t1 WHERE value IS NOT NULL", *_B, _KNOWN, _FLAGS, _TABLE1),
    "k6_table2": sql("SELECT CASE WHEN type = 'outdated' THEN 'Outdated' ELSE 'Misspelling' END AS type, binomial AS name_used, coalesce(correction, '') AS correct_name, coalesce(common_name, '') AS common_name, n AS papers FROM tops LEFT JOIN fix USING (binomial) WHERE rank <= 20 AND type <> 'changed'", *_B, _TOP, _LAST),
    "k5_summary_json": sql("SELECT p AS papers, excluded, pi AS pct_issues, (SELECT nullif(count(*), 0) FROM ib WHERE type = 'unknown') AS unknown, (SELECT species FROM sp GROUP BY 1 ORDER BY count(*) DESC, species LIMIT 1) AS first_species, excluded AS listed FROM flags", *_B, _KNOWN, _FLAGS, _SPECIES.format("ib")),
    "k4_results_json": sql("SELECT doc_id, candidates_found, unique_binomials, outdated, coalesce(names, '') AS names FROM results LEFT JOIN (SELECT doc_id, string_agg(binomial, ';' ORDER BY idx) AS names FROM batch GROUP BY 1) USING (doc_id)", *_B),
    "r7_summary": sql("""SELECT p AS papers, excluded, i AS with_issues, o AS with_outdated, m AS with_misspelled, c AS with_changed, u AS with_unknown, pi AS pct_issues, po AS pct_outdated, pm AS pct_misspelled, pc AS pct_changed, pu AS pct_unknown, mentions AS species_mentions, journals,
  (SELECT coalesce(string_agg(type || ':' || n, ';' ORDER BY type), '') FROM (SELECT type, count(*) AS n FROM ib GROUP BY 1)) AS totals,
  (SELECT coalesce(string_agg(binomial || ':' || n, ';' ORDER BY rank), '') FROM tops WHERE type = 'outdated' AND rank <= 20) AS top_outdated, (SELECT coalesce(string_agg(binomial || ':' || n, ';' ORDER BY rank), '') FROM tops WHERE type = 'misspelled' AND rank <= 20) AS top_misspelled,
  (SELECT coalesce(string_agg(binomial || ':' || n, ';' ORDER BY rank), '') FROM tops WHERE type = 'changed' AND rank <= 20) AS top_changed,
  (SELECT coalesce(string_agg(species || ':' || n, ';' ORDER BY n DESC, species), '') FROM (SELECT species, count(*) AS n FROM sp GROUP BY 1 ORDER BY n DESC, species LIMIT 30)) AS top_species,
  (SELECT coalesce(string_agg(journal || ':' || n, ';' ORDER BY n DESC, journal), '') FROM (SELECT journal, count(*) AS n FROM meta JOIN inc USING (doc_id) GROUP BY 1 ORDER BY n DESC, journal LIMIT 15)) AS top_journals,
  (SELECT coalesce(string_agg(doc_id || ':' || title || ':' || journal || ':' || issues, ';' ORDER BY issues DESC, doc_id), '') FROM (SELECT * FROM inc JOIN meta USING (doc_id) ORDER BY issues DESC, doc_id LIMIT 10)) AS top_papers,
  (SELECT coalesce(string_agg(doc_id || ':' || doi || ':' || title || ':' || unknown, ';' ORDER BY doc_id), '') FROM ratios JOIN meta USING (doc_id) WHERE ratio < 0.3 AND unknown > 3) AS excluded_papers FROM flags""", *_B, _KNOWN, _FLAGS, _TOP, _SPECIES.format("ib")),
    "f16_percent": "SELECT n, total, CAST(printf('%.1f', n / total * 100) AS DOUBLE) AS share FROM (SELECT DISTINCT total, unnest(range(0, total + 1)) AS n FROM (SELECT c_custkey % 64 + 1 AS total FROM customer))",
    "k1_dictionary_artefact": f"WITH {_LINES}, d AS (SELECT *, genus || ' ' || species AS binomial FROM species QUALIFY row_number() OVER (PARTITION BY genus || ' ' || species ORDER BY page, line_no) = 1) SELECT binomial, tax_class, tax_order, tax_family, author, occurrence, flags, common_name_en, common_name_es, common_name_fr, (SELECT count(*) FROM d)::INTEGER AS species_count, (SELECT count(DISTINCT genus) FROM d)::INTEGER AS genera FROM d",
    "k2_cache": f"WITH {_PARTS}, {_CACHE} SELECT binomial, valid, CASE WHEN length(binomial) % 4 = 0 THEN 'again' ELSE current_name END AS current_name, array_to_string(synonyms, ',') AS synonyms FROM cache",
    "k3_papers_cache": "SELECT '10.1/' || doc_id AS doi, doc_id, CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'downloaded' ELSE 'failed' END AS download_status FROM documents",
    "k9_append": f"WITH {_VISITS} SELECT country, CASE WHEN {_VALID} THEN 'visits' ELSE 'rejected' END AS \"table\", count(*) AS n FROM v GROUP BY 1, 2",
    "k10_pdf_magic": "SELECT page_id, strlen(CASE page_id % 3 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN '%pdf' ELSE '' END || html)::BIGINT AS size FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0 AND html IS NOT NULL",
    "s1_text_lines": f"WITH {_LINES} SELECT line, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY 1",
    "s3_or_empty": "SELECT count(*) AS n FROM labels",
    "s4_text_dir": "SELECT sha256(rtrim(text, chr(10))) AS text_sha256, count(*) AS n FROM benchmark GROUP BY 1",
    "s13_joined_items": "SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY 1",
    "f17_known_ratio": sql("SELECT doc_id, ratio, ratio < 0.3 AND unknown > 3 AS excluded FROM ratios", *_B),
    "f8_headers": f"WITH {_LINES} SELECT page, line_no, kind, name FROM kinds",
    "j13_forward_fill": f"WITH {_LINES} SELECT page, line_no, tax_class, tax_order, tax_family FROM filled",
    "f4_species_lines": f"WITH {_LINES} SELECT page, line_no, genus, species, author, flags, occurrence, common_name_en, common_name_es, common_name_fr FROM species",
    "d1_dictionary": f"WITH {_LINES} SELECT binomial, page, line_no, tax_class, tax_order, tax_family, author, flags, occurrence FROM (SELECT *, genus || ' ' || species AS binomial FROM species) QUALIFY row_number() OVER (PARTITION BY binomial ORDER BY page, line_no) = 1",
    "p6_transfers": f"WITH {_LINES} SELECT genus, count(*) AS n FROM species WHERE starts_with(author, '(') GROUP BY 1",
    "s15_html_text": f"WITH {_HTML} SELECT page_id, sha256(t) AS text_sha256 FROM shown",
    "x8_status": _by_entry(lambda e: [e[1]], "valid", "current_name").replace("SELECT page_id, valid", "SELECT page_id, valid = 'true' AS valid"),
    "u2_synonyms": _by_entry(lambda e: [(x,) for x in e[2]], "synonym"),
    "x9_original_genera": _by_entry(lambda e: [(x,) for x in e[3]], "original_genus"),
    "j9_asof_pages": _by_entry(lambda e: e[4], "kind", "of", "epithet", "old_genus"),
    "p7_empty_cache": f"WITH {_PARTS}, {_CACHE} SELECT ord, binomial FROM cache WHERE valid IS NOT NULL AND len(synonyms) = 0 AND current_name = ''",
    "a20_mismatch": f"WITH {_PARTS}, {_CACHE} SELECT binomial, current_name FROM cache WHERE valid IS NOT NULL AND current_name NOT IN ('', binomial)",
    "f11_doi": "SELECT page_id, '10.' || page_id AS doi FROM pages WHERE page_id % 3 <> 2",
    "f12_hash": "SELECT page_id, substr(sha256(url), 1, 16) AS file_hash FROM pages",
    "f13_url_candidates": "SELECT id AS page_id, attempt, candidate FROM (" + _URLS.replace("{}", "SELECT id, replace(u, '{n}', id::VARCHAR) AS url, replace(d, '{n}', id::VARCHAR) AS doi FROM (SELECT page_id AS id, page_id % " + str(len(URLS)) + " AS k FROM pages) JOIN (VALUES " + ", ".join(_SQL_ROW((i, *u)) for i, u in enumerate(URLS)) + ") t(k, u, d) USING (k)") + ")",
    "f13_page_urls": "SELECT id AS page_id, attempt, candidate FROM (" + _URLS.replace("{}", "SELECT page_id AS id, url, '10.5/' || page_id AS doi FROM pages") + ")",
    "f14_papers": """WITH w AS (SELECT doc_id AS i, 'W' || doc_id AS work_id, '10.1/' || (doc_id // 2) AS doi, CASE doc_id % 6 WHEN 0 THEN 'Stream Fish assemblage of X' WHEN 2 THEN 'Reef fish of Y' END AS title, * EXCLUDE (doc_id) FROM documents WHERE doc_id % 10 <> 9 AND doc_id % 6 IN (0, 2))
  SELECT doi, title, array_to_string(list_transform(list_filter(range(1, least(i % 13 + 1, 10) + 1), lambda k: k % 4 <> 0), lambda k: 'A' || k), ';') AS authors, CAST(2000 + i % 20 AS INTEGER) AS year, CASE WHEN i % 4 <> 0 THEN source ELSE 'Unknown' END AS journal, CASE WHEN i % 5 <> 0 THEN 'https://host/' || i ELSE '' END AS oa_url,
  CAST(n_chars AS INTEGER) AS cited_by_count, work_id, 'pending' AS download_status FROM w QUALIFY row_number() OVER (PARTITION BY doi ORDER BY work_id) = 1""",
    "f18_title_lists": f"""SELECT doc_id, title FROM (SELECT doc_id, 'Notes on ' || CASE doc_id % 7 WHEN 1 THEN w[:-2] WHEN 2 THEN upper(w) ELSE w END || ' of a lake' || CASE WHEN doc_id % 3 = 0 THEN ': ' || x ELSE '' END AS title
  FROM (SELECT doc_id, {list(papers.TITLE_INCLUDE)}[doc_id % {len(papers.TITLE_INCLUDE)} + 1] AS w, {list(papers.TITLE_EXCLUDE)}[(doc_id // 3) % {len(papers.TITLE_EXCLUDE)} + 1] AS x FROM documents))
  WHERE list_bool_or(list_transform({list(papers.TITLE_INCLUDE)}, lambda w: contains(lower(title), w))) AND NOT list_bool_or(list_transform({list(papers.TITLE_EXCLUDE)}, lambda w: contains(lower(title), w)))""",
    "s2_dictionary_json": f"""WITH {_LINES}, d AS MATERIALIZED (SELECT *, genus || ' ' || species AS binomial FROM species QUALIFY row_number() OVER (PARTITION BY genus || ' ' || species ORDER BY page, line_no) = 1),
 known AS (SELECT arg_max(binomial, line_no) AS binomial, lower(common_name_en) AS l_name FROM d WHERE common_name_en <> '' GROUP BY lower(common_name_en))
 SELECT 'name' AS kind, binomial AS name, coalesce(flags, '') AS flags, coalesce(l_name, '') AS "of" FROM d LEFT JOIN known USING (binomial)
 UNION ALL SELECT 'synonym', 'Neo ' || species, '', arg_min(binomial, line_no) FROM d WHERE line_no % 4 = 1 GROUP BY species UNION ALL SELECT DISTINCT 'genus', lower(genus), '', '' FROM d UNION ALL SELECT 'metadata', 'list', '8', '2023'""",
    "f18_title_filter": "SELECT doc_id FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE NOT (contains(t, 'heat') OR contains(t, 'ion the')) AND (contains(t, 'the ') OR contains(t, ' of') OR contains(t, 'der'))",
    "d4_dedupe": "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1",
    "f23_usable_text": "SELECT length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 100 AS usable, count(*) AS n FROM documents GROUP BY 1",
    "s10_joined_pages": "SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS text_sha256 FROM conversations WHERE trim(text) <> '' GROUP BY 1",
    "j7_remaining": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "l1_limit": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500",
    "e7_status_machine": "SELECT status, CASE WHEN status = 'pending' AND ok THEN 'downloaded' WHEN status = 'pending' THEN 'failed' WHEN status = 'failed' THEN 'pending' ELSE status END AS next, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'downloaded' END AS status, o_totalprice > 100000 AS ok FROM orders) GROUP BY 1, 2",
    "p13_event_validation": f"WITH {_VISITS} SELECT country, {_VALID} AND event_id % 50 <> 0 AS valid, count(*) AS n FROM v GROUP BY 1, 2",
    "p13_issue_validation": "SELECT doc_id, doc_id % 10 <> 0 AND length(lang) <= 50 AND length(split_part(text, chr(10), 1)) <= 200 AND length(text) <= 2000 AS valid FROM documents",
    "a17_dashboard": f"WITH {_VISITS} SELECT a.*, b.* FROM (SELECT count(*) AS sessions, coalesce(sum(CASE WHEN k * 10 <= 500 THEN k * 10 END), 0)::BIGINT AS species_total FROM v) a, (SELECT count(DISTINCT {_PLACE}) AS locations, count(*) FILTER (lat <> 0 AND lng <> 0) AS markers FROM (SELECT * FROM v ORDER BY ts DESC, event_id DESC LIMIT 500)) b",
    "s14_last_visits": f"WITH {_VISITS} SELECT event_id, user_id FROM v ORDER BY ts DESC, event_id DESC LIMIT 500",
    "p12_markers": f"WITH {_VISITS} SELECT {_PLACE} AS place, count(*) AS n FROM v WHERE lat <> 0 AND lng <> 0 GROUP BY 1",
    "e1_session_dedupe": f"WITH {_VISITS} SELECT user_id, session, event_id FROM v QUALIFY row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) = 1",
    "e2_rate_limit": f"""WITH RECURSIVE {_VISITS}, o AS MATERIALIZED (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM v),
  r AS (SELECT user_id, event_id, ts AS last, k, true AS ok FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, CASE WHEN o.ts - r.last >= INTERVAL 1 HOUR THEN o.ts ELSE r.last END, o.k, o.ts - r.last >= INTERVAL 1 HOUR FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
  SELECT user_id, count(*) AS accepted, sum(event_id)::BIGINT AS event_ids FROM r WHERE ok GROUP BY 1""",
    "e5_counters": f"WITH {_VISITS} SELECT count(*) AS sessions, coalesce(sum(CASE WHEN k * 10 <= 500 THEN k * 10 END), 0)::BIGINT AS species_total FROM v",
}

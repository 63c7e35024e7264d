"""Artefacts: the dictionary, per-paper results, summary and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.operators.corpus import TYPE_ORDER
from binomia.operators.dictionary import Dictionary
from binomia.sources.ledger import Ledger


def dictionary_frame(d: Dictionary) -> DataFrame:
    """The dictionary as one nested row; names keep their order. It is one JSON document, as its readers expect."""
    def ordered(df, key, value):
        return df.agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(key).alias("k"), value.alias("v")))), lambda e: F.struct(e["k"], e["v"]))).alias("m"))

    info = F.struct("flags", F.col("common_name").alias("common_name_en"))
    genera = d.genera.agg(F.sort_array(F.collect_list("l_genus")).alias("genera"))
    return ordered(d.valid, "binomial", info).withColumnRenamed("m", "valid_names").crossJoin(genera).crossJoin(ordered(d.synonyms, "old_name", F.col("new_name")).withColumnRenamed("m", "synonyms"))  # one row each


FIELDS = {"class": "tax_class", "order": "tax_order", "family": "tax_family", "author": "author", "occurrence": "occurrence", "flags": "flags", "common_name_en": "common_name_en", "common_name_es": "common_name_es", "common_name_fr": "common_name_fr"}


def authority_frame(names: DataFrame, synonyms: DataFrame, edition: int, year: int, source: str) -> DataFrame:
    """The whole artefact as one nested row: metadata, every field of each name, genera and synonyms. names: (ord, binomial, and FIELDS' columns), synonyms: (ord, old_name, new_name).

    It is one JSON document, as its readers expect, and holds a reference list; both grow with the list, not with the corpus.
    """
    info = F.struct(*(F.col(c).alias(k) for k, c in FIELDS.items()))
    entries = lambda rows, key, value, to: rows.agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(key).alias("k"), value.alias("v")))), lambda e: F.struct(e["k"], e["v"]))).alias(to))
    genera = names.agg(F.array_sort(F.collect_set(F.substring_index("binomial", " ", 1))).alias("genera"))
    out = entries(names, "binomial", info, "valid_names").crossJoin(genera).crossJoin(entries(synonyms, "old_name", F.col("new_name"), "synonyms"))  # one row each
    meta = F.struct(F.lit(edition).alias("edition"), F.lit(year).alias("year"), F.lit(source).alias("source"), F.size("valid_names").alias("species_count"), F.size("synonyms").alias("synonym_count"))
    return out.select(meta.alias("metadata"), "valid_names", "genera", "synonyms")


def write_json(row: DataFrame, path: str) -> None:
    """A one-row frame as one JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_summary(head: DataFrame, excluded: DataFrame, path: str) -> None:
    """A summary as two tables: its one row as a JSON file in `head`, and the papers that don't count, a line each, in `excluded`."""
    write_json(head, f"{path}/head")
    excluded.write.mode("overwrite").json(f"{path}/excluded")


def write_dictionary(d: Dictionary, path: str) -> None:
    dictionary_frame(d).coalesce(1).write.mode("overwrite").json(path)


def nested_results(results: DataFrame, details: DataFrame) -> DataFrame:
    """A row a paper, with counts by type as a map and its names as an array."""
    types = details.groupBy("doc_id", "type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("classifications"))
    names = details.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "binomial", "type", "suggestion", F.col("common_name").alias("commonName")))).alias("d"))
    names = names.select("doc_id", F.transform("d", lambda x: F.struct(x["binomial"], x["type"], x["suggestion"], x["commonName"])).alias("details"))
    return results.select("doc_id", "candidates_found", "unique_binomials").join(types, "doc_id", "left").join(names, "doc_id", "left")


def write_results(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary_markdown(summed: DataFrame) -> str:
    """corpus.summary's one row as a report."""
    r = summed.first()
    head = lambda *cells: ["", f"| {' | '.join(cells)} |", f"|{'---|' * len(cells)}"]
    out = ["# Names in the corpus", "", "## Overview", "", f"**{r.papers}** papers count."]
    out += [f"Another {r.excluded} are left out, as most of their names aren't in the list."] if r.excluded else []
    out += ["", "## Key findings", ""]
    out += [f"- **{r[f'pct_{k}']:.1f}%** of papers have {what}" for k, what in (("issues", "an outdated or misspelled name"), ("outdated", "an outdated name"), ("misspelled", "a misspelled name"), ("changed", "a name that has changed"))]
    out += [f"- **{r.species_mentions}** names were found, each counted once a paper", "", "## Types", *head("Type", "Count")]
    out += [f"| {t.replace('_', ' ').title()} | {(r.totals or {}).get(t, 0)} |" for t in TYPE_ORDER]
    for title, rows in (("Most common outdated names", r.top_outdated), ("Most common misspellings", r.top_misspelled), ("Most common changed names", r.top_changed)):
        if rows:
            out += ["", f"## {title}", *head("Name", "Papers"), *(f"| *{x.binomial}* | {x.n} |" for x in rows[:10])]
    return "\n".join([*out, "", "## Journals", "", f"The papers come from **{r.journals}** journals.", ""])


def write_texts(df: DataFrame, id_col: str, table: str, path: str, buckets: int) -> DataFrame:
    """Texts as a table bucketed by document, for what is joined to them by document again and again: they are shuffled this once."""
    df.repartition(buckets, id_col).write.bucketBy(buckets, id_col).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


CACHE = "rows"


def append_cache(rows: DataFrame, path: str, at: int) -> None:
    """Rows added to a cache under a number that grows with each writing; all or none of them, and those of a number only once."""
    Ledger(rows.sparkSession, path).commit("cache", at, {CACHE: rows.withColumn("written_at", F.lit(at).cast("long"))})


def compact_cache(spark: SparkSession, path: str, key: str) -> None:
    """A cache as one part, with the latest row of each key alone, which is what is read of it."""
    Ledger(spark, path).compact(CACHE, latest=(key, "written_at"))


def append_valid(df: DataFrame, ok, path: str, number: int) -> None:
    """Valid rows appended to table `valid` of a ledger and the others to `rejected`, in one commit: a number already committed changes nothing."""
    marked = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    Ledger(df.sparkSession, path).commit("visits", number, {"valid": marked.where("_ok").drop("_ok"), "rejected": marked.where("NOT _ok").drop("_ok")})

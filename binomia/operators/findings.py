"""Findings of a scan, what is listed from them, and the corrected text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.functions.shared import written
from binomia.functions.text import splice
from binomia.operators import extract
from binomia.operators.classify import classify
from binomia.operators.dictionary import Dictionary

COLUMNS = ("doc_id", "idx", "end", "text", "binomial", "type", "suggestion", "common_name", "confidence", "edit_distance", "source")
# Fixed values. Types that count as no issue on screen, and those a correction replaces.
NO_ISSUE, CORRECTABLE = ("valid", "common"), ("outdated", "misspelled")
LABELS = {"changed": "Changed in 8th edition", "outdated": "Outdated / Synonym", "misspelled": "Misspelled", "unknown": "Unknown fish name"}
CONFIRM, CONFIRM_SPECIES, NOTHING = " \u2014 confirm intended species", "Confirm this is the intended species", "\u2014"


def binomial_findings(df: DataFrame, id_col: str, text_col: str, d: Dictionary, ascii_space: bool = False) -> DataFrame:
    found = classify(written(extract.candidates(df, id_col, text_col, d.genera, ascii_space), "candidates"), d)
    return found.withColumns({"end": F.col("idx") + F.length("text"), "source": F.lit("binomial")}).select(*COLUMNS)


def scan(df: DataFrame, id_col: str, text_col: str, d: Dictionary, octets: bool = False, ascii_space: bool = False) -> DataFrame:
    """Every classified candidate, and the common names outside their spans; octets: as in extract.common_names(), ascii_space: as in extract."""
    found = binomial_findings(df, id_col, text_col, d, ascii_space)
    common = extract.common_names(df, id_col, text_col, d.common, octets)
    common = common.withColumns({"binomial": F.col("text"), "type": F.lit("common"), "confidence": F.lit(None).cast("double"), "edit_distance": F.lit(None).cast("int"), "source": F.lit("common_name")})
    return extract.without_overlaps(found.unionByName(common.select(*COLUMNS)), F.col("source") == "binomial")


def batch_matches(df: DataFrame, id_col: str, text_col: str, placed: bool = True, ascii_space: bool = False) -> DataFrame:
    """(doc_id, idx, genus, species) of all matches as a table: they are few beside the texts, and read more than once. extract.chosen() of them are the candidates, without the pass for short genera.

    placed: with idx, which costs as much as the search.
    """
    found = extract.every(df, id_col, text_col, ascii_space).select("doc_id", "idx", "genus", "species") if placed else extract.unplaced(df, id_col, text_col, ascii_space)
    return written(found, "matches")


def batch_of(candidates: DataFrame, d: Dictionary, pairs: DataFrame | None = None) -> DataFrame:
    """(doc_id, idx, binomial, type, suggestion, common_name): each name once a document, where it comes first; without idx if candidates have none. pairs: as in classify().

    Candidates are of one case, a capital and small letters. Most are no names, so they are classified before the first of each is looked for; a name's class is the same wherever it stands.
    """
    at = [c for c in ("idx",) if c in candidates.columns]
    named = classify(candidates.select("doc_id", *at, "genus", "species"), d, pairs).select("doc_id", *at, "binomial", "type", "suggestion", F.when(F.col("common_name") != "", F.col("common_name")).alias("common_name"))
    own = ("doc_id", "binomial", "type", "suggestion", "common_name")
    return named.groupBy(*own).agg(F.min("idx").alias("idx")).select("doc_id", "idx", *own[1:]) if at else named.distinct()


def batch(df: DataFrame, id_col: str, text_col: str, d: Dictionary) -> DataFrame:
    return batch_of(extract.chosen(batch_matches(df, id_col, text_col)), d)


def distinct_names(found: DataFrame) -> DataFrame:
    """The first finding of each name, as written, in each document; binomials come before common names."""
    order = found.withColumn("rank", (F.col("source") != "binomial").cast("int"))
    first = order.groupBy("doc_id", "binomial").agg(F.min(F.struct("rank", "idx", "type", "suggestion", "common_name")).alias("m"))
    return first.select("doc_id", "binomial", "m.rank", "m.idx", "m.type", "m.suggestion", "m.common_name")


def species_list(found: DataFrame, d: Dictionary) -> DataFrame:
    """Distinct names with the name they should have and its common name."""
    names = d.valid.select(F.col("binomial").alias("suggestion"), F.col("common_name").alias("suggested_common"))
    return distinct_names(found).join(names, "suggestion", "left").select("doc_id", "binomial", "type", "suggestion", F.coalesce(F.nullif("suggested_common", F.lit("")), F.nullif("common_name", F.lit("")), F.lit("")).alias("common_name"))


def label(kind: F.Column) -> F.Column:
    """What a type is shown as; one without a label by its own name."""
    out = kind
    for name, shown in LABELS.items():
        out = F.when(kind == name, shown).otherwise(out)
    return out


def issue_table(found: DataFrame, d: Dictionary) -> DataFrame:
    """(doc_id, binomial, label, instead): distinct names that are neither valid nor common, and what to put in their place or look at."""
    names = d.valid.select(F.col("binomial").alias("suggestion"), F.nullif("common_name", F.lit("")).alias("known_as"))
    rows = distinct_names(found.where(~F.col("type").isin(*NO_ISSUE))).join(names, "suggestion", "left")
    own = F.nullif("common_name", F.lit(""))
    changed = F.when(own.isNotNull(), F.concat(F.lit("Now: "), own, F.lit(CONFIRM))).otherwise(CONFIRM_SPECIES)
    better = F.concat("suggestion", F.when(F.col("known_as").isNull(), "").otherwise(F.concat(F.lit(" ("), F.col("known_as"), F.lit(")"))))
    instead = F.when(F.col("type") == "changed", changed).when(F.coalesce("suggestion", F.lit("")) != "", better).otherwise(NOTHING)
    return rows.select("doc_id", "binomial", label(F.col("type")).alias("label"), instead.alias("instead"))


def badges(found: DataFrame) -> DataFrame:
    """Per document: issues, counted before names are made distinct, and distinct names."""
    issue = ~F.col("type").isin(*NO_ISSUE)
    return found.groupBy("doc_id").agg(F.count_if(issue).alias("issues"), F.countDistinct("binomial").alias("species"))


def correct_text(df: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """(doc_id, corrected): outdated and misspelled names replaced where they stand.

    Corrections are hashed by document, and texts stream past them: a table of texts that is bucketed by document (`sinks.write_texts`) is neither shuffled nor sorted.
    """
    fixes = found.where(F.col("suggestion").isNotNull() & F.col("type").isin(*CORRECTABLE))
    per_doc = fixes.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("idx", "end", F.col("suggestion").alias("new")))).alias("spans"))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    joined = docs.join(per_doc.hint("shuffle_hash"), F.col("doc_id") == F.col("_doc"), "left")
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("t")).otherwise(splice(F.col("t"), F.col("spans"))).alias("corrected"))

"""Aggregation of per-paper results over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values. Types of names that the dictionary knows, the order of types in a chart, thresholds of the exclusion.
KNOWN_TYPES = ("valid", "changed", "outdated", "misspelled", "common_name")
TYPE_ORDER = ("valid", "changed", "common_name", "outdated", "misspelled", "unknown")
LABELS = {"valid": "Valid", "changed": "Changed (8th ed.)", "common_name": "Common Name", "outdated": "Outdated Synonym", "misspelled": "Misspelled", "unknown": "Unknown (not in AFS)"}
RATIO, UNKNOWN = 0.3, 3
WORST = ("misspelled", "outdated", "changed", "valid")


def type_counts(details: DataFrame) -> DataFrame:
    return details.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def paper_results(docs: DataFrame, candidates: DataFrame, details: DataFrame) -> DataFrame:
    """A row a paper: candidates found (all of them), names classified, counts of the types; docs: (doc_id)."""
    n = lambda t: F.count_if(F.col("type") == t).alias(t)
    found = candidates.groupBy("doc_id").agg(F.count("*").alias("candidates_found"))
    of = details.groupBy("doc_id").agg(F.count("*").alias("unique_binomials"), *(n(t) for t in (*TYPE_ORDER, "common")))
    return docs.select("doc_id").join(found, "doc_id", "left").join(of, "doc_id", "left").na.fill(0)


def known_ratio() -> F.Column:
    """The share of classified names that the dictionary knows; 1 where there are none."""
    known = sum((F.col(t) for t in KNOWN_TYPES), F.lit(0))
    return F.coalesce(known / F.nullif(known + F.col("unknown"), F.lit(0)), F.lit(1.0))


def excluded() -> F.Column:
    return (known_ratio() < RATIO) & (F.col("unknown") > UNKNOWN)


def with_exclusion(results: DataFrame) -> DataFrame:
    return results.withColumn("ratio", known_ratio()).withColumn("excluded", excluded())


def included(results: DataFrame) -> DataFrame:
    """Papers that count: all but those that are about names the dictionary doesn't know."""
    return results.where(~excluded())


def included_details(details: DataFrame) -> DataFrame:
    """Names of papers that count, each paper's names counted in its own group: they needn't be classified a second time."""
    own = Window.partitionBy("doc_id")
    counts = {t: F.count_if(F.col("type") == t).over(own) for t in (*KNOWN_TYPES, "unknown")}
    return details.withColumns(counts).where(~excluded()).drop(*counts)


def with_metadata(papers: DataFrame, known: DataFrame) -> DataFrame:
    """papers (doc_id, ...) with doi, title, year and journal of known (doc_id, doi, title, year, journal), and what stands for those of a paper not known."""
    unknown = {"doi": F.lit(""), "title": F.lit("Unknown"), "year": F.lit(0), "journal": F.lit("Unknown")}
    met = papers.join(known.select("doc_id", *(F.col(c).alias(f"_{c}") for c in unknown), F.lit(True).alias("_met")), "doc_id", "left")
    return met.withColumns({c: F.when(F.col("_met"), F.coalesce(f"_{c}", v)).otherwise(v) for c, v in unknown.items()}).drop("_met", *(f"_{c}" for c in unknown))


def totals(details: DataFrame) -> DataFrame:
    return details.groupBy("type").agg(F.count("*").alias("n"))


def paper_flags(results: DataFrame) -> DataFrame:
    """Papers with names of each kind; an issue is an outdated or misspelled name."""
    some = lambda c: F.count_if(c > 0)
    return results.agg(F.count("*").alias("papers"), some(F.col("outdated") + F.col("misspelled")).alias("with_issues"), *(some(F.col(t)).alias(f"with_{t}") for t in ("outdated", "misspelled", "changed", "unknown")))


def top(df: DataFrame, key: str, n: int, *by: str) -> DataFrame:
    """The n most frequent values in each group (of `by`), ties by name, with their ranks."""
    counted = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    if not by:
        counted = counted.orderBy(F.desc("n"), key).limit(n)
    rank = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("n"), key)
    return counted.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def top_names(details: DataFrame, n: int = 20) -> DataFrame:
    return top(details.where(F.col("type").isin("outdated", "misspelled", "changed")), "binomial", n, "type")


def species(details: DataFrame) -> DataFrame:
    """Names as they should be, of the four types that have one."""
    return details.where(F.col("type").isin(*WORST)).withColumn("species", F.coalesce("suggestion", "binomial"))


def top_species(details: DataFrame, n: int = 30) -> DataFrame:
    return top(species(details), "species", n)


def top_papers(results: DataFrame, n: int = 10) -> DataFrame:
    """Papers with the most issues; of equal ones the first."""
    return results.withColumn("issues", F.col("outdated") + F.col("misspelled")).orderBy(F.desc("issues"), "doc_id").limit(n)


def histogram(results: DataFrame, first: int | None = None) -> DataFrame:
    """(errors, papers): papers by number of issues, 0, 1, 2 and 3+, all four of them. first: the chart as it was published, where only that many
    papers with the most issues are put in their bins and the other papers with issues all count as one."""
    issues = F.col("outdated") + F.col("misspelled")
    every = results.agg(F.count("*").alias("all"), F.count_if(issues == 0).alias("n0"), F.count_if(issues == 1).alias("n1"), F.count_if(issues == 2).alias("n2"), F.count_if(issues >= 3).alias("n3"))
    if first is not None:
        listed = top_papers(results, first).agg(F.count_if(F.col("issues") == 2).alias("n2"), F.count_if(F.col("issues") >= 3).alias("n3"))
        every = every.select("all", "n0").crossJoin(listed).withColumn("n1", F.col("all") - F.col("n0") - F.col("n2") - F.col("n3"))  # one row each
    bins = [F.struct(F.lit(k).alias("errors"), F.col(c).alias("papers")) for k, c in (("0", "n0"), ("1", "n1"), ("2", "n2"), ("3+", "n3"))]
    return every.select(F.explode(F.array(*bins)).alias("b")).select("b.*")


def worst_type(details: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent species with the worst type any of their names has."""
    rank = F.array_position(F.array(*map(F.lit, WORST)), F.col("type"))
    own = species(details).groupBy("species").agg(F.count("*").alias("n"), F.min_by("type", rank).alias("worst"))
    return own.orderBy(F.desc("n"), "species").limit(n)


def corrections(details: DataFrame, every: DataFrame, n: int = 20) -> DataFrame:
    """(type, rank, binomial, n, correction, common_name): the most frequent outdated, then misspelled names. The correction, and the common
    name with one, are those that came last in every paper, whether it counts or not; null where there is none."""
    fixed = every.where(F.col("type").isin("outdated", "misspelled") & (F.coalesce("suggestion", F.lit("")) != ""))
    named = F.when(F.coalesce("common_name", F.lit("")) != "", F.struct("doc_id", "idx"))
    last = fixed.groupBy("binomial").agg(F.max_by("suggestion", F.struct("doc_id", "idx")).alias("correction"), F.max_by("common_name", named).alias("common_name"))
    return top(details.where(F.col("type").isin("outdated", "misspelled")), "binomial", n, "type").join(last, "binomial", "left").select("type", "rank", "binomial", "n", "correction", "common_name")


def issue_rows(details: DataFrame, every: DataFrame, n: int = 20) -> DataFrame:
    """The table of issues, as it is written."""
    kind = F.when(F.col("type") == "outdated", "Outdated").otherwise("Misspelling")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return corrections(details, every, n).select(kind.alias("type"), "rank", F.col("binomial").alias("name_used"), blank("correction").alias("correct_name"), blank("common_name").alias("common_name"), F.col("n").alias("papers"))


def rounded(x: F.Column, unit: int) -> F.Column:
    """A number of 0 to 2^26 in units of 1/10 or 1/100, of its binary value, a half to the even digit: `unit` times it is taken in two parts, each without error."""
    whole = F.floor(x)
    part = x - whole
    high = F.floor(part * (1 << 26)) / F.lit(float(1 << 26))
    units = F.floor(high * unit)
    over, half = (part - high) * unit, F.lit(0.5) - (high * unit - units)
    up = F.when((over > half) | ((over == half) & (units % 2 == 1)), 1).otherwise(0)
    return (whole * unit + units + up) / F.lit(float(unit))


def percent(n: F.Column, total: F.Column) -> F.Column:
    return F.when(total > 0, rounded(n.cast("double") / total.cast("double") * 100, 10)).otherwise(0.0)


def journals(papers: DataFrame, n: int = 15) -> DataFrame:
    return top(papers, "journal", n)


KINDS = ("issues", "outdated", "misspelled", "changed", "unknown")


def summary(results: DataFrame, details: DataFrame, known: DataFrame) -> DataFrame:
    """One row with the corpus's figures and short lists. results: (doc_id, ...) of all papers, details: names of all, known: metadata of papers.

    The lists hold 10 to 30 elements each; excluded papers are counted here, and listed by excluded_papers(). Each part has one row, so they meet without a shuffle.
    """
    marked = with_metadata(with_exclusion(results), known)
    papers, names = marked.where("not excluded"), included_details(details)
    flags = papers.agg(
        F.count("*").alias("papers"), F.count_if(F.col("outdated") + F.col("misspelled") > 0).alias("with_issues"), *(F.count_if(F.col(k) > 0).alias(f"with_{k}") for k in KINDS[1:]),
        F.coalesce(F.sum("unique_binomials"), F.lit(0)).alias("species_mentions"), F.countDistinct("journal").alias("journals"),
    )
    flags = flags.withColumns({f"pct_{k}": percent(F.col(f"with_{k}"), F.col("papers")) for k in KINDS})
    ranked = lambda rows, *fields: F.transform(F.sort_array(F.collect_list(F.struct("rank", *fields))), lambda x: F.struct(*(x[f] for f in fields)))
    named = top_names(names)
    parts = [
        totals(names).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("totals")),
        *(named.where(F.col("type") == t).agg(ranked(named, "binomial", "n").alias(f"top_{t}")) for t in ("outdated", "misspelled", "changed")),
        top_species(names).agg(ranked(names, "species", "n").alias("top_species")),
        journals(papers).agg(ranked(papers, "journal", "n").alias("top_journals")),
        top_papers(papers).withColumn("rank", F.struct(-F.col("issues"), "doc_id")).agg(ranked(papers, "doc_id", "title", "journal", "issues").alias("top_papers")),
        marked.where("excluded").agg(F.count("*").alias("excluded")),
    ]
    out = flags
    for part in parts:
        out = out.crossJoin(part)
    return out


def excluded_papers(results: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, doi, title, ratio, rounded_ratio, unknown) of the papers that don't count: a table, as there may be any number of them."""
    out = with_metadata(with_exclusion(results).where("excluded"), known)
    return out.select("doc_id", "doi", "title", "ratio", rounded(F.col("ratio"), 100).alias("rounded_ratio"), "unknown")


def metrics(summed: DataFrame) -> DataFrame:
    """(place, metric, value): rows of the summary table; of types only those found."""
    shown = lambda k: F.concat(F.col(f"with_{k}").cast("string"), F.lit(" ("), F.when(F.col("papers") > 0, F.col(f"pct_{k}").cast("string")).otherwise("0"), F.lit("%)"))
    text = lambda c: F.col(c).cast("string")
    # Fixed values. Names of the rows.
    cells = [
        ("Papers analyzed", text("papers")), ("Papers excluded (non-NA)", text("excluded")), ("Papers with naming errors", shown("issues")), ("  with outdated names", shown("outdated")), ("  with misspelled names", shown("misspelled")),
        ("Papers with changed names (8th ed.)", shown("changed")), ("Papers with unknown names", shown("unknown")), ("Total unique species detected", text("species_mentions")), ("Journals represented", text("journals")),
    ]
    cells += [(f"  {LABELS[t]}", F.try_element_at("totals", F.lit(t)).cast("string")) for t in TYPE_ORDER]
    rows = summed.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(k).alias("metric"), v.alias("value")) for i, (k, v) in enumerate(cells)))).alias("m"))
    return rows.select("m.*").where("value is not null")

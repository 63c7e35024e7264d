"""Discovery of papers: fields of API rows, relevance, where to fetch from, and the state of the work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values. A title with any of the second list is left out; any of the first is wanted.
TITLE_INCLUDE = (
    "fish assemblage", "fish community", "fish species", "fish diversity", "fish composition", "fish fauna", "fish survey", "fish richness", "fish population",
    "ichthyofauna", "freshwater fish", "reef fish", "stream fish", "river fish", "marine fish", "fish checklist", "fish inventory",
    "larval fish", "juvenile fish", "demersal fish", "fish abundance", "fish distribution", "fish sampling", "fish conservation", "fish habitat", "fish monitoring",
    "native fish", "invasive fish", "nonnative fish", "non-native fish", "threatened fish", "endangered fish",
)
TITLE_EXCLUDE = (
    "aquaculture", "fish oil", "fish meal", "fish feed", "fish consumption", "fish product", "fish market", "fish protein", "fish fillet", "fish flesh",
    "microbiome", "microbiota", "gut bacteria", "zebrafish", "danio rerio", "review", "meta-analysis", "systematic review",
    "erratum", "corrigendum", "correction", "retraction", "book review",
)
AUTHORS = 10


def has_any(text: F.Column, words: tuple[str, ...]) -> F.Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def relevant(title: F.Column, include: tuple[str, ...] = TITLE_INCLUDE, exclude: tuple[str, ...] = TITLE_EXCLUDE) -> F.Column:
    return ~has_any(title, exclude) & has_any(title, include)


def doi(raw: F.Column) -> F.Column:
    """Without its resolver; null where there is none."""
    return F.nullif(F.regexp_replace(F.coalesce(raw, F.lit("")), "^https://doi\\.org/", ""), F.lit(""))


def file_hash(key: F.Column) -> F.Column:
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 16)


def or_default(col: F.Column, default: str) -> F.Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def author_names(authorships: F.Column) -> F.Column:
    """Names of the first ten authorships, those without one left out after the cut."""
    names = F.transform(F.slice(authorships, 1, AUTHORS), lambda a: a["author"]["display_name"])
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def papers(works: DataFrame) -> DataFrame:
    """API rows as papers, those without a DOI or of no relevance left out."""
    out = works.select(
        doi(F.col("doi")).alias("doi"), or_default(F.col("title"), "Untitled").alias("title"), author_names(F.col("authorships")).alias("authors"),
        F.coalesce("publication_year", F.lit(0)).alias("year"), F.coalesce("primary_location.source.display_name", F.lit("Unknown")).alias("journal"),
        F.coalesce("open_access.oa_url", F.lit("")).alias("oa_url"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.coalesce("id", F.lit("")).alias("work_id"), F.lit("pending").alias("download_status"),
    )
    return out.where(F.col("doi").isNotNull() & relevant(F.col("title")))


def url_candidates(url: F.Column, doi_: F.Column) -> F.Column:
    """Where to try for a PDF, best guess first: rewritten addresses of known hosts, else the DOI's, and the address itself."""
    url = F.coalesce(url, F.lit(""))
    has = lambda s: F.contains(url, F.lit(s))
    bare = F.rtrim(url, F.lit("/"))
    wiley = F.regexp_extract(url, "/doi/(10\\.[0-9]{4,}/[^\\s?#]+)", 1)
    rewritten = F.array_compact(
        F.array(
            F.when(has("onlinelibrary.wiley.com") & (wiley != ""), F.concat(F.lit("https://onlinelibrary.wiley.com/doi/pdfdirect/"), wiley, F.lit("?download=true"))),
            F.when(has("mdpi.com") & ~has("/pdf"), F.concat(bare, F.lit("/pdf"))),
            F.when(has("academic.oup.com") & ~has("/pdf"), F.concat(bare, F.lit("/pdf"))),
            F.when(has("link.springer.com/article") & ~has(".pdf"), F.concat(F.replace(url, F.lit("/article/"), F.lit("/content/pdf/")), F.lit(".pdf"))),
            F.when(has("frontiersin.org") & ~has("/pdf"), F.concat(bare, F.lit("/pdf"))),
        )
    )
    resolver = F.concat(F.lit("https://doi.org/"), doi_)
    generic = F.when((F.coalesce(doi_, F.lit("")) != "") & (F.size(rewritten) == 0) & (url != resolver), F.array(resolver)).otherwise(F.array().cast("array<string>"))
    tried = F.concat(rewritten, generic)
    return F.when((url != "") & ~F.array_contains(tried, url), F.array_append(tried, url)).otherwise(tried)


def remaining(all_: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do."""
    return all_.join(done.select(key), key, "left_anti")


def next_status(status: F.Column, succeeded: F.Column, retry: bool = False) -> F.Column:
    """pending becomes downloaded or failed; failed becomes pending where a retry is asked for; downloaded stays."""
    out = F.when((status == "pending") & succeeded, "downloaded").when(status == "pending", "failed")
    return (out.when(status == "failed", "pending") if retry else out).otherwise(status)


def usable_text(text: F.Column) -> F.Column:
    """More than a hundred characters without the white space around them."""
    return F.length(F.btrim(text, F.lit(" \t\r\n"))) > 100


def is_pdf(content: F.Column, content_type: F.Column | None = None) -> F.Column:
    """By the first bytes, or by what the server said it is, where that is known; nothing at all is none."""
    said = F.lit(False) if content_type is None else F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False)) | said


def with_location(works: DataFrame, locations: DataFrame, key: str) -> DataFrame:
    """The open copy's address of each work, null where none is known. locations: (key, url_for_pdf)."""
    return works.join(locations.select(key, "url_for_pdf"), key, "left")


def first_usable(attempts: DataFrame, usable: F.Column, n: int, *order: str) -> DataFrame:
    """The first n usable attempts: where a run of downloads stops."""
    return attempts.where(usable).orderBy(*order).limit(n)


def downloaded(work: DataFrame) -> DataFrame:
    return work.where((F.col("download_status") == "downloaded") & (F.coalesce("pdf_file", F.lit("")) != ""))


def acceptance(seen: DataFrame, accepted: F.Column, *by: str) -> DataFrame:
    """Works seen and accepted, and their ratio."""
    out = seen.groupBy(*by).agg(F.count("*").alias("seen"), F.count_if(accepted).alias("accepted"))
    return out.withColumn("rate", F.col("accepted") / F.col("seen"))

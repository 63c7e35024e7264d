"""Authority tables: species lines of a printed list, and entries of catalogue pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binomia.functions.text import bound, html_text, matches

# Fixed values. Lines that are no data, headers, and the parts of a species line.
SKIP = "^(?:[0-9]+$|NAMES OF FISHES$|SCIENTIFIC NAME|\\s*OCCURRENCE|COMMON NAME|TABLE\\s+1\\.|A\\s*=|[*^]\\s+indicates|Common names|the exclusive|added to the|in French|En-,\\s*Sp-)"
CLASS = "^CLASS\\s+([A-Z]+)\\s*[–—-]+\\s*(.+)$"
ORDER = "^ORDER\\s+([A-Z]{4,})"
FAMILY = "^[*^&+]?\\s*([A-Z][a-z]+(?:idae|inae))\\s*[–—-]"
OCCURRENCE = "^[APFarCMU]"
GENUS, EPITHET = "^[A-Z][a-z]+$", "^[a-z][a-z-]{2,}$"
# Fixed values. What stands in a catalogue entry, and a header by its look alone.
HEADER = "([a-z][a-z-]+),\\s+([A-Z][a-z]+)(?=(?:\\s+\\([A-Z][a-z]+\\))?\\s+[A-Z][a-z]+\\s+\\[)"
LOOSE = "([a-z][a-z-]+),\\s+([A-Z][a-z]+)"
STATUS, CURRENT = "(Synonym of|Valid as) ([A-Z][a-z]+ [a-z]+)", "Current status[:\\s]+{}\\s+([A-Z][a-z]+\\s+[a-z]+)"


def headers(lines: DataFrame) -> DataFrame:
    """lines (page, line_no, line) with kind (skip, class, order, family, species, other) and the header's name."""
    is_ = lambda rx: F.col("line").rlike(rx)
    kind = F.when(F.trim("line") == "", "skip").when(is_(SKIP), "skip").when(is_(CLASS), "class").when(is_(ORDER), "order").when(is_(FAMILY), "family").when(is_("\\.{4,}"), "species").otherwise("other")
    get = lambda rx: F.regexp_extract("line", rx, 1)
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))
    name = F.when(F.col("kind") == "class", capital(get(CLASS))).when(F.col("kind") == "order", capital(get(ORDER))).when(F.col("kind") == "family", get(FAMILY))
    return lines.withColumn("kind", kind).withColumn("name", name)


def fill_forward(kinds: DataFrame) -> DataFrame:
    """Species lines with the class, order and family above them. Pages are numbered, and what stood last on each is carried on, so that a page is a partition."""
    own = Window.partitionBy("page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    levels = ("class", "order", "family")
    seen = kinds
    for k in levels:
        seen = seen.withColumn(f"tax_{k}", F.last(F.when(F.col("kind") == k, F.col("name")), ignorenulls=True).over(own))
    ends = kinds.groupBy("page").agg(*(F.max_by("name", F.when(F.col("kind") == k, F.col("line_no"))).alias(f"end_{k}") for k in levels))
    before = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # a row a page
    carried = ends.select("page", *(F.last(f"end_{k}", ignorenulls=True).over(before).alias(f"from_{k}") for k in levels))
    out = seen.where(F.col("kind") == "species").join(carried, "page")
    return out.select("page", "line_no", "line", *(F.coalesce(f"tax_{k}", f"from_{k}", F.lit("")).alias(f"tax_{k}") for k in levels))


def species_lines(lines: DataFrame) -> DataFrame:
    """lines with genus, species, author, flags, occurrence and three common names; others than species rows are left out."""
    parts = F.split("line", "\\.{2,}")
    col = lambda i: F.trim(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")))
    trimmed = F.ltrim(F.element_at(parts, 1), F.lit("\t "))
    flags = F.regexp_extract(trimmed, "^([*^&+]+)\\s*", 1)
    rest = F.split(F.trim(F.regexp_replace(trimmed, "^[*^&+]+\\s*", "")), "\\s+")
    author = F.btrim(F.array_join(F.slice(rest, 3, F.greatest(F.size(rest) - 2, F.lit(0))), " "), F.lit(".,"))
    out = lines.where(F.col("line").rlike("\\.{4,}") & (F.size(parts) >= 3) & (F.size(rest) >= 3)).select(
        "*", F.element_at(rest, 1).alias("genus"), F.rtrim(F.element_at(rest, 2), F.lit(".,")).alias("species"), author.alias("author"), flags.alias("flags"),
        F.regexp_replace(col(2), "\\s+", "").alias("occurrence"), col(3).alias("common_name_en"), col(4).alias("common_name_es"), col(5).alias("common_name_fr"),
    )
    return out.where(F.col("occurrence").rlike(OCCURRENCE) & F.col("genus").rlike(GENUS) & F.col("species").rlike(EPITHET))


def page_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    return pages.withColumn("text", html_text(F.col(html_col)))


def _hits(pages: DataFrame, pattern: str, id_cols: list[str]) -> DataFrame:
    """Matches with two groups and their places; a look-ahead isn't part of a match."""
    return pages.select(*id_cols, F.explode(matches(F.col("text"), pattern)).alias("m")).select(*id_cols, "m.*")


def entries(pages: DataFrame, id_cols: list[str]) -> DataFrame:
    """Every status line with the entry header nearest before it: (ids, idx, status, genus, species, epithet, old_genus)."""
    heads = _hits(pages, HEADER, id_cols).select(*id_cols, "idx", (F.col("idx") + F.length("text")).alias("at"), F.struct(F.col("g1").alias("epithet"), F.col("g2").alias("old_genus"), F.col("idx").alias("from")).alias("head"), F.lit(None).alias("status"))
    said = _hits(pages, STATUS, id_cols).select(*id_cols, "idx", F.col("idx").alias("at"), F.lit(None).cast("struct<epithet:string,old_genus:string,from:int>").alias("head"), F.struct(F.col("g1").alias("kind"), F.col("g2").alias("of")).alias("status"))
    order = Window.partitionBy(*id_cols).orderBy("at", F.col("head").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = heads.withColumn("status", F.lit(None).cast("struct<kind:string,of:string>")).unionByName(said).withColumn("near", F.last("head", ignorenulls=True).over(order))
    return both.where("status is not null").select(*id_cols, "idx", "status.kind", "status.of", "near.epithet", "near.old_genus", F.col("near.from").alias("head_idx"))


def current_status(pages: DataFrame, id_cols: list[str]) -> DataFrame:
    """(ids, valid, current_name): of a page's first status lines; a synonym's outweighs a valid name's."""
    first = lambda kind: F.regexp_extract("text", CURRENT.format(kind), 1)
    out = pages.select(*id_cols, first("Valid as").alias("v"), first("Synonym of").alias("s"))
    return out.select(*id_cols, ((F.col("v") != "") & (F.col("s") == "")).alias("valid"), F.when(F.col("s") != "", F.col("s")).otherwise(F.col("v")).alias("current_name"))


def synonyms(pages: DataFrame, id_cols: list[str], genus: str = "genus", species: str = "species") -> DataFrame:
    """(ids, synonym): older names of each page's target (columns genus and species).

    Headers of entries said to be synonyms of the target, or valid as it under another genus, and the other names these entries
    cite up to there. A target's epithet may go on in the text, as a longer epithet that begins alike.
    """
    e = entries(pages, [*id_cols, genus, species]).where("epithet is not null").withColumn("target", F.concat_ws(" ", genus, species))
    hit = F.startswith(F.col("of"), F.col("target"))
    old = F.concat_ws(" ", "old_genus", "epithet")
    strict, placed = hit & (F.col("kind") == "Synonym of"), hit & (F.col("kind") == "Valid as")
    named = e.where(strict | (placed & (F.col("old_genus") != F.col(genus)))).select(*id_cols, "target", old.alias("synonym"))
    spans = e.where(strict | placed).select(*id_cols, genus, species, "target", F.col("kind").alias("by"), F.col("head_idx").alias("from"), F.col("idx").alias("to"))
    o = e.select(*(F.col(c).alias(f"_{c}") for c in id_cols), F.col("kind").alias("_kind"), F.col("of").alias("_of"), F.col("idx").alias("_idx"))
    same = (F.col("_idx") >= F.col("from")) & (F.col("_idx") <= F.col("to")) & (F.col("_kind") == F.col("by"))
    for c in id_cols:
        same &= F.col(c) == F.col(f"_{c}")
    cited = spans.join(o, same)
    other_genus = F.substring_index("_of", " ", 1)
    as_valid = F.when(F.startswith(F.substring_index("_of", " ", -1), F.col(species)) & (other_genus != F.col(genus)), F.concat_ws(" ", other_genus, F.col(species)))
    cited = cited.select(*id_cols, "target", F.when(F.col("by") == "Synonym of", F.col("_of")).otherwise(as_valid).alias("synonym"))
    return named.unionByName(cited).where("synonym is not null and synonym <> target").select(*id_cols, "synonym").distinct()


def original_genera(pages: DataFrame, id_cols: list[str], genus: str = "genus", species: str = "species") -> DataFrame:
    """(ids, original_genus): genera, other than the target's, whose entries have the target's epithet, or one that ends so; where a page
    has none, those nearest before each "Valid as" the target, by a header's look alone. A row a genus, each once a page."""
    own = F.struct(F.regexp_extract_all("text", F.lit(HEADER), F.lit(1)).alias("epithet"), F.regexp_extract_all("text", F.lit(HEADER), F.lit(2)).alias("genus"))
    heads = bound(own, lambda h: F.filter(F.arrays_zip(h["epithet"].alias("e"), h["genus"].alias("g")), lambda x: F.endswith(x["e"], F.col(species)) & (x["g"] != F.col(genus))))
    parts = F.split("text", F.concat(F.lit("Valid as "), F.col(genus), F.lit(" "), F.col(species)), -1)
    # what stands before each status, from the end of the one before, whose epithet may itself begin a header
    before = bound(parts, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, k: F.when(k > 0, F.concat(F.col(species), x)).otherwise(x)))
    nearest = F.transform(before, lambda x: F.try_element_at(F.regexp_extract_all(x, F.lit(LOOSE), F.lit(2)), F.lit(-1)))
    said = F.filter(nearest, lambda g: g.isNotNull() & (g != F.col(genus)))
    by_header = F.transform(heads, lambda x: x["g"])
    found = pages.withColumn("_heads", by_header)
    return found.select(*id_cols, F.explode(F.array_distinct(F.when(F.size("_heads") > 0, F.col("_heads")).otherwise(said))).alias("original_genus"))


def is_transfer(author: str = "author") -> F.Column:
    """An author in brackets: the species was first described in another genus."""
    return F.startswith(F.col(author), F.lit("("))


def is_empty(cache: DataFrame) -> DataFrame:
    """Cached species for which a catalogue gave nothing; failed requests (valid is null) aren't empty."""
    return cache.where("valid is not null and size(synonyms) = 0 and current_name = ''")


def empty_transfers(cache: DataFrame, names: DataFrame) -> DataFrame:
    """Genus transfers for which a catalogue gave nothing, with author and family: what to ask for again. names: (binomial, author, tax_family)."""
    return is_empty(cache).select("binomial").join(names, "binomial").where(is_transfer())


def mismatches(cache: DataFrame) -> DataFrame:
    """Names that a catalogue has another current name for."""
    return cache.where("valid is not null and current_name <> '' and current_name <> binomial").select("binomial", "current_name")

"""A deterministic dictionary drawn from the driver's tables, in DataFrames and in DuckDB SQL.

Names are the candidates in `benchmark`, in order of appearance: every fourth is a synonym of the accepted one before it, the
others are accepted, every fourth of them with a changed name. Common names are the first two lower-case words of each
benchmark item, and the ten most frequent pairs of `documents` that are no name. Genera are those of accepted names, and the
five most frequent two-letter ones in `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binomia.functions.shared import spread, written
from binomia.operators import dictionary as D
from binomia.operators import extract
from binomia.operators.dictionary import Dictionary

PHRASE = "([a-z]{4,} [a-z]{4,})"
EXTRA, SHORT = 10, 5
_kept: dict[tuple[str, str], Dictionary] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), dealt over all cores where the table is small."""
    return spread(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, binomial) of benchmark's candidates."""
    found = extract.primary(read(spark, sf_dir, "benchmark"), "item_id", "text", ascii_space=True)
    first = found.groupBy(F.concat_ws(" ", "genus", "species").alias("binomial")).agg(F.min(F.struct("doc_id", "idx")).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at")).cast("long").alias("ord"), "binomial")  # a reference list


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_genus, l_species, n) of documents' matches of all passes: each distinct lower-case pair once, as a table."""
    return _tallied(extract.counted(texts(spark, sf_dir), "text", ascii_space=True), F.sum("n"))


def counts_of(matches: DataFrame) -> DataFrame:
    """The same, from matches that are extracted already."""
    return _tallied(matches, F.count("*"))


def _tallied(found: DataFrame, n: Column) -> DataFrame:
    return written(found.groupBy(F.lower("genus").alias("l_genus"), F.lower("species").alias("l_species")).agg(n.alias("n")), "counts")


def dictionary(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> Dictionary:
    """found: counts() of documents' matches, where the caller has them, so that texts are searched once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = _dictionary(spark, sf_dir, counts(spark, sf_dir) if found is None else found)
    return _kept[key]


def _dictionary(spark: SparkSession, sf_dir: str, found: DataFrame) -> Dictionary:
    bench = read(spark, sf_dir, "benchmark")
    all_names = names(spark, sf_dir).cache()
    accepted = all_names.where("ord % 4 <> 3")
    ranked = accepted.select((F.row_number().over(Window.orderBy("ord")) - 1).alias("rank"), F.col("binomial").alias("of"))
    total = accepted.agg(F.count("*").alias("total"))
    genera = accepted.select(F.lower(F.substring_index("binomial", " ", 1)).alias("l_genus")).distinct()
    phrases = bench.select(F.col("item_id").alias("ord"), F.regexp_extract("text", PHRASE, 1).alias("name")).where("name <> ''").withColumn("k", F.col("ord"))
    found = found.where(~F.contains("l_species", F.lit("-")))
    pairs = found.where(F.length("l_genus") > 2).withColumn("name", F.concat_ws(" ", "l_genus", "l_species")).join(genera, "l_genus", "left_anti").join(all_names.select(F.lower("binomial").alias("name")), "name", "left_anti")
    frequent = pairs.orderBy(F.desc("n"), "name").limit(EXTRA).select("name", F.row_number().over(Window.orderBy(F.desc("n"), "name")).cast("long").alias("k"))
    frequent = frequent.select((F.col("k") + 1_000_000).alias("ord"), "name", "k")
    common = phrases.unionByName(frequent).crossJoin(total).withColumn("rank", F.col("k") % F.col("total")).join(ranked, "rank").select("ord", "name", F.col("of").alias("binomial"))
    common = D.common_names(common).cache()
    named = common.groupBy("binomial").agg(F.max_by("name", "ord").alias("common_name"))
    valid = accepted.join(named, "binomial", "left").select("ord", "binomial", F.when(F.col("ord") % 4 == 1, "*").otherwise("").alias("flags"), F.coalesce("common_name", F.lit("")).alias("common_name"))
    synonyms = all_names.where("ord % 4 = 3").join(all_names.select((F.col("ord") + 1).alias("ord"), F.col("binomial").alias("new_name")), "ord").select("ord", F.col("binomial").alias("old_name"), "new_name")
    short = found.where(F.length("l_genus") == 2).groupBy("l_genus").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "l_genus").limit(SHORT).select("l_genus")
    return Dictionary(D.valid_names(valid).cache(), D.synonym_names(synonyms).cache(), genera.union(short).distinct().cache(), common)


# DuckDB SQL of the same.

CAND_RX = r"\b([A-Z][a-z]{2,})\s+([a-z]{3,})\b"
HYPHEN_RX = r"\b([A-Z][a-z]{2,})\s+([a-z]-[a-z]{2,})\b"
SHORT_RX = r"\b([A-Z][a-z])\s+([a-z]{3,})\b"


def hits_sql(table: str, key: str, rx: str) -> str:
    """(key, idx, text, genus, species) of a pattern's matches."""
    return f"""
SELECT {key}, CAST(sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS idx,
       m AS text, regexp_extract(m, '^([A-Za-z]+)', 1) AS genus, regexp_extract(m, '([a-z-]+)$', 1) AS species
FROM (SELECT {key}, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS k
      FROM (SELECT {key}, regexp_extract_all(text, '{rx}') AS ms, string_split_regex(text, '{rx}') AS gaps FROM {table}))
WINDOW w AS (PARTITION BY {key} ORDER BY k)"""


DICT_SQL = f"""
x1 AS MATERIALIZED ({hits_sql("documents", "doc_id", CAND_RX)}),
bx AS MATERIALIZED ({hits_sql("benchmark", "item_id", CAND_RX)}),
names AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a) AS ord, binomial FROM (SELECT genus || ' ' || species AS binomial, min((item_id, idx)) AS a FROM bx GROUP BY 1)),
accepted AS MATERIALIZED (SELECT ord, binomial, row_number() OVER (ORDER BY ord) - 1 AS rank, count(*) OVER () AS total, lower(split_part(binomial, ' ', 1)) AS l_genus FROM names WHERE ord % 4 <> 3),
frequent AS (SELECT name, row_number() OVER (ORDER BY n DESC, name) AS k FROM (
   SELECT lower(genus) || ' ' || lower(species) AS name, count(*) AS n FROM x1 WHERE lower(genus) NOT IN (SELECT l_genus FROM accepted)
   AND lower(genus) || ' ' || lower(species) NOT IN (SELECT lower(binomial) FROM names) GROUP BY 1) ORDER BY n DESC, name LIMIT {EXTRA}),
raw_common AS (SELECT item_id AS ord, regexp_extract(text, '{PHRASE}', 1) AS name, item_id AS k FROM benchmark WHERE regexp_extract(text, '{PHRASE}', 1) <> ''
   UNION ALL SELECT 1000000 + k, name, k FROM frequent),
common AS MATERIALIZED (SELECT min(c.ord) AS ord, lower(name) AS l_name, max_by(name, c.ord) AS name, max_by(a.binomial, c.ord) AS binomial FROM raw_common c JOIN accepted a ON c.k % a.total = a.rank GROUP BY lower(name)),
valid AS MATERIALIZED (SELECT a.ord, a.binomial, CASE WHEN a.ord % 4 = 1 THEN '*' ELSE '' END AS flags, coalesce(n.name, '') AS common_name, a.l_genus,
   lower(substr(a.binomial, strpos(a.binomial, ' ') + 1)) AS l_species, lower(a.binomial) AS l_binomial
   FROM accepted a LEFT JOIN (SELECT binomial, max_by(name, ord) AS name FROM common GROUP BY 1) n USING (binomial)),
synonyms AS MATERIALIZED (SELECT s.ord, s.binomial AS old_name, v.binomial AS new_name, lower(split_part(s.binomial, ' ', 1)) AS l_genus,
   lower(substr(s.binomial, strpos(s.binomial, ' ') + 1)) AS l_species, lower(s.binomial) AS l_old FROM names s JOIN names v ON v.ord = s.ord - 1 WHERE s.ord % 4 = 3),
raw_short AS MATERIALIZED ({hits_sql("documents", "doc_id", SHORT_RX)}),
genera AS MATERIALIZED (SELECT DISTINCT l_genus FROM accepted UNION SELECT l_genus FROM (SELECT lower(genus) AS l_genus, count(*) AS n FROM raw_short GROUP BY 1 ORDER BY n DESC, l_genus LIMIT {SHORT}))"""

X4_SQL = f"""
x2 AS ({hits_sql("documents", "doc_id", HYPHEN_RX)}),
x4b AS MATERIALIZED (SELECT doc_id, idx, min_by(genus, rule) AS genus, min_by(species, rule) AS species, min_by(text, rule) AS text, min(rule) AS rule
   FROM (SELECT *, 1 AS rule FROM x1 UNION ALL SELECT *, 2 FROM x2) GROUP BY doc_id, idx),
x4 AS MATERIALIZED (SELECT doc_id, idx, min_by(genus, rule) AS genus, min_by(species, rule) AS species, min_by(text, rule) AS text, min(rule) AS rule
   FROM (SELECT *, 1 AS rule FROM x1 UNION ALL SELECT *, 2 FROM x2 UNION ALL SELECT *, 3 FROM raw_short WHERE lower(genus) IN (SELECT l_genus FROM genera)) GROUP BY doc_id, idx)"""


def osa_sql(a: str, b: str) -> str:
    """Optimal string alignment by rows of the table."""
    return f"""list_reduce(range(1, length({a}) + 1), lambda st, i: {{'pp': st.p, 'p': list_reduce(range(1, length({b}) + 1), lambda c, j: list_append(c, least(st.p[j + 1] + 1, c[j] + 1,
  st.p[j] + CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN 0 ELSE 1 END,
  CASE WHEN i > 1 AND j > 1 AND substr({a}, i, 1) = substr({b}, j - 1, 1) AND substr({a}, i - 1, 1) = substr({b}, j, 1) THEN st.pp[j - 1] + 1 ELSE 1000 END)), [i])}},
  {{'pp': range(0, length({b}) + 1), 'p': range(0, length({b}) + 1)}}).p[length({b}) + 1]"""


def nearest_sql(pairs: str, names_: str, payload: str) -> str:
    """(l_genus, l_species, payload, dist, genus_dist) of pairs (l_genus, l_species); unrestricted edit distance is no more than OSA."""
    return f"""
SELECT l_genus, l_species, m.{payload} AS {payload}, m.dist AS dist, m.gd AS genus_dist FROM (
 SELECT l_genus, l_species, min({{'dist': gd + sd, 'ord': ord, '{payload}': {payload}, 'gd': gd}}) AS m FROM (
  SELECT q.l_genus, q.l_species, e.ord, e.{payload}, {osa_sql("q.l_genus", "e.l_genus")} AS gd, {osa_sql("q.l_species", "e.l_species")} AS sd
  FROM {pairs} q JOIN {names_} e ON abs(length(q.l_genus) - length(e.l_genus)) <= 2
   AND (q.l_genus[1] = e.l_genus[1] OR (length(q.l_genus) >= 8 AND abs(ord(q.l_genus[1]) - ord(e.l_genus[1])) <= 2))
   AND abs(ord(q.l_species[1]) - ord(e.l_species[1])) <= 2
   AND damerau_levenshtein(q.l_genus, e.l_genus) <= 2 AND damerau_levenshtein(q.l_species, e.l_species) <= 2)
 WHERE gd <= 2 AND gd + sd <= 2 GROUP BY 1, 2)"""


def stop_sql() -> str:
    from binomia.operators.classify import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


CLASS_SQL = f"""
pairs AS MATERIALIZED (SELECT DISTINCT lower(genus) AS l_genus, lower(species) AS l_species, lower(genus) || ' ' || lower(species) AS l_full FROM x4 WHERE length(species) >= 3 AND lower(species) NOT IN ({stop_sql()})),
lv AS (SELECT l_binomial, max_by(binomial, ord) AS valid_name, max_by(flags, ord) AS flags, max_by(common_name, ord) AS valid_common FROM valid GROUP BY 1),
ls AS (SELECT l_old, max_by(new_name, ord) AS synonym_of FROM synonyms GROUP BY 1),
j AS MATERIALIZED (SELECT p.*, valid_name, flags, valid_common, synonym_of, c.binomial AS common_of, c.name AS common_as, g.l_genus IS NOT NULL AS known FROM pairs p LEFT JOIN lv ON l_full = l_binomial
   LEFT JOIN ls ON l_full = l_old LEFT JOIN common c ON l_full = c.l_name LEFT JOIN genera g ON p.l_genus = g.l_genus),
ns AS MATERIALIZED (SELECT * FROM ({nearest_sql("(SELECT * FROM j WHERE valid_name IS NULL AND synonym_of IS NULL)", "synonyms", "new_name")}) WHERE genus_dist = 0 AND dist > 0),
nv AS MATERIALIZED ({nearest_sql("(SELECT * FROM j WHERE valid_name IS NULL AND synonym_of IS NULL AND common_of IS NULL AND NOT EXISTS (SELECT 1 FROM ns WHERE ns.l_genus = j.l_genus AND ns.l_species = j.l_species))", "valid", "binomial")}),
cls AS MATERIALIZED (SELECT * FROM (SELECT j.l_genus, j.l_species, valid_name,
   CASE WHEN valid_name IS NOT NULL THEN CASE WHEN contains(flags, '*') THEN 'changed' ELSE 'valid' END WHEN synonym_of IS NOT NULL OR ns.new_name IS NOT NULL THEN 'outdated' WHEN common_of IS NOT NULL THEN 'common'
        WHEN nv.binomial IS NOT NULL THEN 'misspelled' WHEN known THEN 'unknown' END AS type,
   CASE WHEN valid_name IS NOT NULL THEN NULL ELSE coalesce(synonym_of, ns.new_name, common_of, nv.binomial) END AS suggestion,
   CASE WHEN valid_name IS NOT NULL THEN coalesce(valid_common, '') WHEN synonym_of IS NOT NULL OR ns.new_name IS NOT NULL THEN NULL ELSE common_as END AS common_name,
   CAST(CASE WHEN valid_name IS NOT NULL THEN 1.0 WHEN synonym_of IS NOT NULL THEN 0.95 WHEN ns.dist = 1 THEN 0.8 WHEN ns.dist = 2 THEN 0.6 WHEN common_of IS NOT NULL THEN 1.0
        WHEN known AND nv.dist = 1 THEN 0.7 WHEN known AND nv.dist = 2 THEN 0.5 WHEN nv.dist = 1 THEN 0.6 WHEN nv.dist = 2 THEN 0.4 ELSE 0.3 END AS DOUBLE) AS confidence,
   CAST(CASE WHEN valid_name IS NOT NULL OR synonym_of IS NOT NULL THEN 0 WHEN ns.dist IS NOT NULL THEN ns.dist WHEN common_of IS NOT NULL THEN 0 ELSE nv.dist END AS INTEGER) AS edit_distance
   FROM j LEFT JOIN ns ON j.l_genus = ns.l_genus AND j.l_species = ns.l_species LEFT JOIN nv ON j.l_genus = nv.l_genus AND j.l_species = nv.l_species) WHERE type IS NOT NULL)"""

COMMON_SQL = f"""
w AS (SELECT doc_id, w, k, CAST(sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY k) + coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS idx
   FROM (SELECT doc_id, unnest(ms) AS w, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS k
   FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z][-a-zA-Z]*') AS ms, string_split_regex(text, '[a-zA-Z][-a-zA-Z]*') AS gaps FROM documents))),
met AS (SELECT w.doc_id, w.idx, c.l_name, c.name, c.binomial, length(c.l_name) AS size, d.text AS t, length(d.text) AS n FROM w JOIN common c ON lower(w.w) = split_part(c.l_name, ' ', 1) AND contains(c.l_name, ' ') JOIN documents d USING (doc_id)),
tried AS (SELECT *, unnest([0, -1, 0, 1]) AS delta, unnest([0, 1, 2, 3]) AS turn FROM met),
fits AS (SELECT *, idx + size + delta AS e, lower(substr(t, idx + 1, size + delta)) AS s FROM tried WHERE idx + size + delta <= n AND size + delta > 0 AND (idx + size + delta = n OR NOT regexp_matches(substr(t, idx + size + delta + 1, 1), '[a-zA-Z-]'))),
took AS (SELECT doc_id, idx, l_name, name, binomial, t, min({{'turn': turn, 'e': e}}) AS m FROM fits WHERE (turn = 0 AND s = l_name) OR (turn > 0 AND size >= 6 AND damerau_levenshtein(s, l_name) <= 1 AND {osa_sql("s", "l_name")} <= 1) GROUP BY ALL),
hits AS MATERIALIZED (SELECT doc_id, idx, CAST(m.e AS INTEGER) AS "end", substr(t, idx + 1, m.e - idx) AS text, binomial AS suggestion, name AS common_name, m.turn = 0 AS exact FROM took)"""

FOUND_SQL = """
found AS MATERIALIZED (SELECT doc_id, idx, idx + length(text) AS "end", text, genus || ' ' || species AS binomial, type, suggestion, common_name, confidence, edit_distance, 'binomial' AS source
   FROM x4 JOIN cls ON lower(genus) = l_genus AND lower(species) = l_species),
scan AS MATERIALIZED (SELECT * FROM found UNION ALL SELECT doc_id, idx, "end", text, text, 'common', suggestion, common_name, NULL, NULL, 'common_name' FROM hits h
   WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = h.doc_id AND h.idx < f."end" AND h."end" > f.idx))"""

BATCH_SQL = """
batch AS MATERIALIZED (SELECT doc_id, idx, genus || ' ' || species AS binomial, type, suggestion, nullif(common_name, '') AS common_name
   FROM (SELECT doc_id, min(idx) AS idx, min_by(genus, idx) AS genus, min_by(species, idx) AS species, lower(genus) AS l_genus, lower(species) AS l_species FROM x4b GROUP BY doc_id, lower(genus), lower(species)) JOIN cls USING (l_genus, l_species)),
results AS MATERIALIZED (SELECT d.doc_id, coalesce(candidates_found, 0) AS candidates_found, coalesce(unique_binomials, 0) AS unique_binomials, coalesce(valid, 0) AS valid, coalesce(changed, 0) AS changed, coalesce(outdated, 0) AS outdated,
   coalesce(misspelled, 0) AS misspelled, coalesce(unknown, 0) AS unknown, coalesce(common, 0) AS common, 0::BIGINT AS common_name FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS candidates_found FROM x4b GROUP BY 1) c USING (doc_id)
   LEFT JOIN (SELECT doc_id, count(*) AS unique_binomials, count(*) FILTER (type = 'valid') AS valid, count(*) FILTER (type = 'changed') AS changed, count(*) FILTER (type = 'outdated') AS outdated,
     count(*) FILTER (type = 'misspelled') AS misspelled, count(*) FILTER (type = 'unknown') AS unknown, count(*) FILTER (type = 'common') AS common FROM batch GROUP BY 1) b USING (doc_id)),
ratios AS MATERIALIZED (SELECT *, coalesce((valid + changed + outdated + misspelled + common_name) / nullif(valid + changed + outdated + misspelled + common_name + unknown, 0), 1.0)::DOUBLE AS ratio FROM results),
inc AS MATERIALIZED (SELECT *, outdated + misspelled AS issues FROM ratios WHERE NOT (ratio < 0.3 AND unknown > 3)),
ib AS MATERIALIZED (SELECT * FROM batch WHERE doc_id IN (SELECT doc_id FROM inc))"""


def sql(select: str, *parts: str) -> str:
    """A query over the stand-in's tables."""
    return f"WITH {','.join((DICT_SQL, *parts))}\n{select}"

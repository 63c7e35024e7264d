"""Classification of candidate binomials: exact joins first, a nearest-neighbour join for what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.functions.shared import written
from binomia.operators.dictionary import Dictionary, last_wins
from binomia.operators.fuzzy import nearest

# Fixed values. Words that are never an epithet.
STOP_WORDS = (
    "sp", "spp", "cf", "aff", "nr", "var", "subsp", "the", "and", "for", "are", "but", "not", "you", "all", "can", "has", "her", "was", "one",
    "our", "out", "its", "with", "that", "have", "from", "this", "will", "been", "than", "them", "into", "also", "each", "which", "their",
    "were", "other", "about", "these", "would", "there", "after", "between", "found", "used", "where", "most", "using", "during", "including", "however",
)
# Fixed values. Confidence by kind; of near matches at distance 1 and 2.
EXACT, SYNONYM, UNKNOWN = 1.0, 0.95, 0.30
NEAR_SYNONYM, SAME_GENUS, OTHER_GENUS = (0.80, 0.60), (0.70, 0.50), (0.60, 0.40)


def is_epithet(species) -> F.Column:
    return (F.length(species) >= 3) & ~F.lower(species).isin(*STOP_WORDS)


def classify_pairs(pairs: DataFrame, d: Dictionary) -> DataFrame:
    """(l_genus, l_species, type, valid_name, suggestion, common_name, confidence, edit_distance) of distinct lower-case pairs; pairs that look like no name are left out.

    valid_name: the accepted name as written, for valid and changed names. What the exact joins give is a table, as both searches and the result start from it. Near names
    and classes are tables too: both are few beside the pairs, and joins with them go by their size.
    """
    full = F.concat_ws(" ", "l_genus", "l_species")
    p = pairs.select("l_genus", "l_species").where(is_epithet(F.col("l_species"))).withColumn("l_full", full)
    valid = last_wins(d.valid.select("ord", "l_binomial", "binomial", "flags", "common_name"), "l_binomial").select(F.col("l_binomial").alias("l_full"), F.col("binomial").alias("valid_name"), "flags", F.col("common_name").alias("valid_common"))
    synonyms = last_wins(d.synonyms.select("ord", "l_old", "new_name"), "l_old").select(F.col("l_old").alias("l_full"), F.col("new_name").alias("synonym_of"))
    common = d.common.select(F.col("l_name").alias("l_full"), F.col("binomial").alias("common_of"), F.col("name").alias("common_as"))
    known = d.genera.select("l_genus", F.lit(True).alias("known_genus"))
    p = p.join(valid, "l_full", "left").join(synonyms, "l_full", "left").join(common, "l_full", "left").join(known, "l_genus", "left")
    p = written(p, "pairs")
    open_ = p.where("valid_name is null and synonym_of is null")
    # a near synonym counts only where the genus is right, so its genus must be one of theirs; what wins is decided over all of them
    near_syn = nearest(open_.join(d.synonyms.select("l_genus").distinct(), "l_genus", "left_semi"), d.synonyms, "new_name").where("genus_dist = 0 and dist > 0")
    near_syn = written(near_syn.select("l_genus", "l_species", F.col("new_name").alias("near_new"), F.col("dist").alias("near_dist")), "near")
    left = open_.where("common_of is null").select("l_genus", "l_species").join(near_syn.select("l_genus", "l_species"), ["l_genus", "l_species"], "left_anti")
    near = written(nearest(left, d.valid, "binomial").select("l_genus", "l_species", F.col("binomial").alias("like"), F.col("dist").alias("like_dist")), "like")
    p = p.join(near_syn, ["l_genus", "l_species"], "left").join(near, ["l_genus", "l_species"], "left")
    by = lambda dist, pair: F.when(F.col(dist) == 1, pair[0]).otherwise(pair[1])
    is_valid, is_syn, is_near_syn, is_common, is_known, is_like = (F.col(c).isNotNull() for c in ("valid_name", "synonym_of", "near_new", "common_of", "known_genus", "like"))
    kind = F.when(is_valid, F.when(F.contains("flags", F.lit("*")), "changed").otherwise("valid")).when(is_syn | is_near_syn, "outdated").when(is_common, "common").when(is_like, "misspelled").when(is_known, "unknown")
    suggestion = F.when(is_valid, None).when(is_syn, F.col("synonym_of")).when(is_near_syn, F.col("near_new")).when(is_common, F.col("common_of")).otherwise(F.col("like"))
    sure = F.when(is_valid, EXACT).when(is_syn, SYNONYM).when(is_near_syn, by("near_dist", NEAR_SYNONYM)).when(is_common, EXACT).when(is_like & is_known, by("like_dist", SAME_GENUS)).when(is_like, by("like_dist", OTHER_GENUS)).otherwise(UNKNOWN)
    dist = F.when(is_valid | is_syn, 0).when(is_near_syn, F.col("near_dist")).when(is_common, 0).otherwise(F.col("like_dist"))
    name = F.when(is_valid, F.coalesce("valid_common", F.lit(""))).when(is_syn | is_near_syn, None).when(is_common, F.col("common_as"))
    out = p.select("l_genus", "l_species", kind.alias("type"), "valid_name", suggestion.alias("suggestion"), name.alias("common_name"), sure.alias("confidence"), dist.alias("edit_distance"))
    return written(out.where("type is not null"), "classes")


def classify(found: DataFrame, d: Dictionary, pairs: DataFrame | None = None) -> DataFrame:
    """Candidates (doc_id, idx, genus, species, text, ...) with their class; those that look like no name are left out. Each distinct pair is classified once.

    pairs: the candidates' distinct (l_genus, l_species), where the caller has them.
    """
    lower = found.withColumns({"l_genus": F.lower("genus"), "l_species": F.lower("species")})
    classes = classify_pairs(lower.select("l_genus", "l_species").distinct() if pairs is None else pairs, d)
    binomial = F.concat_ws(" ", "genus", "species")
    out = lower.join(classes, ["l_genus", "l_species"]).withColumn("binomial", binomial)
    return out.withColumn("canonical", F.coalesce("valid_name", "binomial")).drop("l_genus", "l_species", "valid_name")

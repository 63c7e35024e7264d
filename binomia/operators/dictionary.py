"""The reference dictionary: accepted names, synonyms, genera and common names as ordered tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dictionary:
    """valid(ord, binomial, flags, common_name, l_genus, l_species, l_binomial), synonyms(ord, old_name, new_name, l_genus, l_species, l_old), genera(l_genus), common(ord, l_name, name, binomial, n_words, first_word)."""

    valid: DataFrame
    synonyms: DataFrame
    genera: DataFrame
    common: DataFrame


def _split_name(name: str):
    return F.lower(F.element_at(F.split(name, " ", 2), 1)), F.lower(F.coalesce(F.try_element_at(F.split(name, " ", 2), F.lit(2)), F.lit("")))


def last_wins(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """A row a key: values of the last one, in the place of the first."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(order).alias(order), *(F.max_by(c, order).alias(c) for c in rest)).select(*df.columns)


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, an aggregate that is combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*(key if c == key else F.col(f"_first.{c}") for c in df.columns))


def valid_names(df: DataFrame) -> DataFrame:
    """df: (ord, binomial, flags, common_name)."""
    genus, species = _split_name("binomial")
    return df.select("ord", "binomial", "flags", "common_name", genus.alias("l_genus"), species.alias("l_species"), F.lower("binomial").alias("l_binomial"))


def synonym_names(df: DataFrame) -> DataFrame:
    """df: (ord, old_name, new_name)."""
    genus, species = _split_name("old_name")
    return df.select("ord", "old_name", "new_name", genus.alias("l_genus"), species.alias("l_species"), F.lower("old_name").alias("l_old"))


def common_names(df: DataFrame) -> DataFrame:
    """df: (ord, name, binomial); of names equal but for case the last wins."""
    own = df.select("ord", F.lower("name").alias("l_name"), "name", "binomial")
    words = F.split("l_name", "\\s+")
    return last_wins(own, "l_name").select("ord", "l_name", "name", "binomial", F.size(words).alias("n_words"), F.element_at(words, 1).alias("first_word"))


def genera_of(valid: DataFrame) -> DataFrame:
    return valid.select("l_genus").distinct()


def metadata(d: Dictionary) -> DataFrame:
    """One row of counts."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(d.valid, "species_count").join(n(d.synonyms, "synonym_count")).join(n(d.genera, "genus_count")).join(n(d.common, "common_name_count"))


def new_synonyms(found: DataFrame, valid: DataFrame) -> DataFrame:
    """found (ord, old_name, new_name): without names that are accepted ones; of an old name's rows the last wins."""
    return last_wins(found.join(valid.select(F.col("binomial").alias("old_name")), "old_name", "left_anti").select("ord", "old_name", "new_name"), "old_name")


def ordered_distinct(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): each key's distinct values in the order in which they first come; a value takes part once a key, however often it comes."""
    first = df.groupBy(key, value).agg(F.min(order).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("values"))

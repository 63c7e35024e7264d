"""Nearest dictionary name of a pair of words, by an index of shortened forms.

Words at most d edits apart (insertions, deletions, changes, swaps of neighbours) have a form in common that each gives by leaving out at most d letters. With two edits for both
words together, a name is indexed under its genus and species with up to two letters left out between them; pairs are shortened alike and meet names by equality. A
key holds nearly all of both words, so what meets hardly grows with the dictionary, and no key is hot.

A pair has some hundreds of such keys, a word some dozens, and many pairs share a word. So distinct words are searched first, by the same argument, and only pairs whose words' least distances
from entries' words come to d at most are shortened.

Spark counts a row of forms as it counts the word, and a table by its compressed files, so it would take pairs of a hundred MB for few and collect them in the driver. Pairs grow with the
texts and are never broadcast; forms of listed names are, where they are counted to be FEW at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.functions.distance import osa_within
from binomia.functions.shared import written
from binomia.functions.text import bound

MAX = 2
LONG = 8  # from this length on a genus may begin with a letter near by
NEAR = 2
FEW = 250_000  # rows of listed names' forms that are broadcast, some 160 bytes each


def without_one(word: Column) -> Column:
    """The word's forms with one letter left out."""
    n, some = F.length(word), F.array().cast("array<string>")
    return F.when(n == 0, some).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, n)))))


def without_two(word: Column) -> Column:
    """The word's forms with two letters left out."""
    n, some = F.length(word), F.array().cast("array<string>")
    cut = lambda i, j: F.concat(F.left(word, i - 1), F.substring(word, i + 1, j - i - 1), F.substring(word, j + 1, n))
    both = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: cut(i, j))))
    return F.when(n < 2, some).otherwise(F.array_distinct(both))


def keys(genus: Column, species: Column) -> Column:
    """Hashes of both words with up to two letters left out between them."""
    hashed = lambda g, s: F.transform(g, lambda x: F.xxhash64(x, s))

    def of(b: Column) -> Column:
        g, s = b["g"], b["s"]
        g1, s1 = b["g1"], b["s1"]
        each = F.flatten(F.transform(s1, lambda y: hashed(g1, y)))
        return F.array_distinct(F.concat(F.array(F.xxhash64(g, s)), hashed(g1, s), F.transform(s1, lambda y: F.xxhash64(g, y)), hashed(without_two(g), s), F.transform(without_two(s), lambda y: F.xxhash64(g, y)), each))

    return bound(F.struct(genus.alias("g"), species.alias("s"), without_one(genus).alias("g1"), without_one(species).alias("s1")), of)


def name_index(names: DataFrame, payload: str) -> DataFrame:
    """(key, ord, e_genus, e_species, payload) of names (ord, l_genus, l_species, payload): a row a shortened form."""
    return names.select(F.explode(keys(F.col("l_genus"), F.col("l_species"))).alias("key"), "ord", F.col("l_genus").alias("e_genus"), F.col("l_species").alias("e_species"), F.col(payload))


def write_index(names: DataFrame, payload: str, table: str, path: str, buckets: int) -> DataFrame:
    """name_index() as a bucketed table, for a list that is searched often: only the pairs are shuffled then."""
    name_index(names, payload).repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", path).mode("overwrite").saveAsTable(table)
    return names.sparkSession.table(table)


def _apart(a: str, b: str) -> Column:
    return F.abs(F.ascii(a) - F.ascii(b))


def _fits_genus() -> Column:
    letter = F.when(F.length("l_genus") >= LONG, _apart("l_genus", "e_genus") <= NEAR).otherwise(_apart("l_genus", "e_genus") == 0)
    return letter & (F.abs(F.length("l_genus") - F.length("e_genus")) <= MAX)


def _fits_species() -> Column:
    return _apart("l_species", "e_species") <= NEAR


def _sent(forms: DataFrame) -> DataFrame:
    """forms (key, ...) of listed names for a join with those of texts' words: broadcast if they are few, else neither side is."""
    return F.broadcast(forms) if forms.count() <= FEW else forms.hint("merge")


def near_words(words: DataFrame, entries: DataFrame, own: str, entry: str, fits: Column) -> DataFrame:
    """(own, least): distinct words of the column `own` that are MAX edits at most from a word of the column `entry` that fits, and how near the nearest is."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = lambda c: F.explode(bound(F.col(c), lambda w: F.array_distinct(F.transform(F.concat(F.array(w), without_one(w), without_two(w)), lambda x: F.xxhash64(x)))))
    # few bytes but much work: twice as many partitions, as the same number by the same key is merged with distinct's own step, whose partitions are lowered to fit the bytes
    q = words.select(own).distinct().repartition(2 * parts, own).withColumn("key", short(own))
    e = entries.select(entry).distinct().withColumn("key", short(entry))
    found = q.join(_sent(e), "key").where(fits & (F.abs(F.length(own) - F.length(entry)) <= MAX)).select(own, entry).distinct()
    return found.withColumn("dist", osa_within(F.col(own), F.col(entry), MAX)).where(F.col("dist") <= MAX).groupBy(own).agg(F.min("dist").alias("least"))


def met(pairs: DataFrame, index: DataFrame, payload: str) -> DataFrame:
    """(l_genus, l_species, ord, e_genus, e_species, payload): the candidates of each pair that the rules' filters leave, once."""
    # few bytes but much work: a number of partitions that is given isn't lowered to fit the bytes
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = pairs.select("l_genus", "l_species").repartition(parts, "l_genus", "l_species").withColumn("key", F.explode(keys(F.col("l_genus"), F.col("l_species"))))
    return q.join(_sent(index), "key").where(_fits_genus() & _fits_species()).select("l_genus", "l_species", "ord", "e_genus", "e_species", payload).distinct()


def nearest(pairs: DataFrame, names: DataFrame, payload: str, index: DataFrame | None = None) -> DataFrame:
    """(l_genus, l_species, payload, dist, genus_dist): the entry of names with the least sum of both words' distances, 2 at most.

    pairs: distinct (l_genus, l_species); names: (ord, l_genus, l_species, payload); index: of these names, if it is written already. Of entries as near the first in
    order wins. An entry passes only with the same first letter of the genus - or, for long genera, one at most two letters away - and a length at most two apart.
    """
    pairs = written(pairs.select("l_genus", "l_species"), "searched")
    listed = names.select(F.col("l_genus").alias("e_genus"), F.col("l_species").alias("e_species"))
    for own, entry, fits in (("l_genus", "e_genus", _fits_genus()), ("l_species", "e_species", _fits_species())):
        # a table: the next word's search and the join with what it finds both start from it
        words = near_words(pairs, listed, own, entry, fits).withColumnRenamed("least", f"least_{own}")
        pairs = written(pairs.join(words.hint("merge"), own), "near_word")  # both grow with the texts
    pairs = pairs.where(F.col("least_l_genus") + F.col("least_l_species") <= MAX)
    found = met(pairs, name_index(names, payload) if index is None else index, payload)
    both = [osa_within(F.col(a), F.col(b), MAX) for a, b in (("l_genus", "e_genus"), ("l_species", "e_species"))]
    near = found.where(both[0] + both[1] <= MAX)
    best = near.groupBy("l_genus", "l_species").agg(F.min(F.struct((both[0] + both[1]).alias("dist"), "ord", payload, both[0].alias("genus_dist"))).alias("b"))
    return best.select("l_genus", "l_species", F.col(f"b.{payload}").alias(payload), "b.dist", "b.genus_dist")

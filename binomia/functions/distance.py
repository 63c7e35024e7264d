"""Edit distance with adjacent transpositions (optimal string alignment) as a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours, no part edited twice; rows of the table by nested aggregates."""
    n, m = F.length(a), F.length(b)
    big = F.lit(1 << 20)

    def row(s: Column, i: Column) -> Column:
        x, x0 = F.substring(a, i, F.lit(1)), F.substring(a, i - 1, F.lit(1))

        def cell(c: Column, j: Column) -> Column:
            y, y0 = F.substring(b, j, F.lit(1)), F.substring(b, j - 1, F.lit(1))
            swap = F.when((i > 1) & (j > 1) & (x == y0) & (x0 == y), F.get(s["older"], j - 2) + 1).otherwise(big)
            best = F.least(F.get(s["old"], j) + 1, F.get(c, j - 1) + 1, F.get(s["old"], j - 1) + F.when(x == y, 0).otherwise(1), swap)
            return F.array_append(c, best)

        return F.struct(s["old"].alias("older"), F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell).alias("old"))

    first = F.sequence(F.lit(0), m)
    table = F.aggregate(F.sequence(F.lit(1), n), F.struct(first.alias("older"), first.alias("old")), row, lambda s: F.get(s["old"], m))
    return F.when(n == 0, m).when(m == 0, n).otherwise(table)


def letters(a: Column) -> Column:
    """The letters of a word in order of the alphabet."""
    return F.array_join(F.sort_array(F.split(a, "")), "")


def osa_within(a: Column, b: Column, k: int | Column) -> Column:
    """osa, or k + 1 where it is more; k: 2 at most.

    Without a swap it is Levenshtein's distance, which is built in; a swap counts as two there. So up to 1 they agree, at 2 and 4 only words
    of the same letters differ by swaps alone, and at 3 only words whose letters differ by one edit. The table is computed for these few.
    """
    k = k if isinstance(k, Column) else F.lit(k)
    plain = F.levenshtein(a, b, 4)
    swapped = F.when(plain == 3, F.levenshtein(letters(a), letters(b), 2) >= 0).otherwise(letters(a) == letters(b))
    near = F.when(plain <= 1, plain).when(swapped, osa(a, b)).otherwise(plain)
    return F.when(a == b, F.lit(0)).when(F.abs(F.length(a) - F.length(b)) > k, k + 1).when(plain < 0, k + 1).otherwise(F.least(near, k + 1))

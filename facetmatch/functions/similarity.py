"""Similarities of normal forms, as columns; the one distance that Spark lacks as an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from facetmatch.functions.text import let, match_normalize

#: Logistic weights by feature, and in the order of features().
BY_FEATURE = {
    "best trigrams": 2.785336213276419, "bias": -5.221066853479779, "equal": 2.0065531794467506, "maker": -0.9401479348182489,
    "numbers": 1.615277122540201, "prefix": 0.06833240278679657, "title trigrams": 2.627068932352563, "tokens": 0.5358987618092962,
}
WEIGHTS = tuple(BY_FEATURE[k] for k in ("bias", "title trigrams", "tokens", "equal", "maker", "numbers", "prefix", "best trigrams"))


def grams_of_normal(norm: Column) -> Column:
    """Distinct trigrams of an already normal string, without spaces, padded by two before and one after."""
    padded = F.concat(F.lit("  "), F.replace(norm, F.lit(" "), F.lit("")), F.lit(" "))
    return let(padded, lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))))


def trigrams(c: Column) -> Column:
    """SIM1: the string is normalised here, also if it was before (which isn't the same)."""
    return grams_of_normal(match_normalize(c))


def dice(a: Column, b: Column) -> Column:
    """SIM2, of two trigram arrays."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def jaccard(a: Column, b: Column) -> Column:
    """SIM3; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def osa(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours, none touched twice (SIM4, SIM5); most + 1 beyond most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y, k) for x, y, k in zip(a, b, most)])


def near(a: Column, b: Column, most: Column) -> Column:
    """A cheap bound that every pair within most swaps and edits passes: a swap is two edits."""
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= 2 * most)

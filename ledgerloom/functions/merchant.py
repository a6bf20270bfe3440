"""Merchant names: normalisation, similarity and category corroboration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import settle

# Keywords that corroborate a merchant category code.
MCC_KEYWORDS = {
    "5251": ("screwfix", "toolstation", "build", "trade", "wickes", "bq"),
    "5541": ("shell", "bp", "esso", "fuel", "petrol"),
    "5542": ("fuel", "petrol"),
    "5399": ("amazon",),
    "4816": ("subscription", "software"),
}
MCC_NEUTRAL, MCC_WEAK = 0.5, 0.3
CONTAINED = 0.85


def normalise(name: Column) -> Column:
    """Lower case without one payment prefix, punctuation and digits at the end."""
    low = F.lower(F.trim(name))
    bare = F.regexp_replace(low, r"^(sq \*|sumup\*|paypal \*|pp\*)", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", ""), "[0-9]+$", "")


def token_overlap(a: Column, b: Column) -> Column:
    """Of normalised names, which are single tokens: 1 if equal or one holds the other."""
    either = F.contains(a, b) | F.contains(b, a)
    long = (F.length(a) >= 3) & (F.length(b) >= 3)
    return F.when((a != "") & (a == b), 1.0).when(long & either, 1.0).otherwise(0.0)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Jaccard of the sets of alphanumeric tokens of two or more characters."""
    tokens = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda x: F.length(x) >= 2))
    ta, tb = tokens(a), tokens(b)
    empty = (F.size(ta) == 0) | (F.size(tb) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(F.array_union(ta, tb)), F.lit(1)))


def jaro_winkler(s1: str, s2: str) -> float:
    """Byte-wise; transpositions are halved without rounding; the prefix bonus always counts."""
    if s1 == s2:
        return 1.0
    a, b = s1.encode(), s2.encode()
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    in_a = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                in_a.append(x)
                break
    m = len(in_a)
    if not m:
        return 0.0
    in_b = [y for j, y in enumerate(b) if taken[j]]
    swapped = sum(x != y for x, y in zip(in_a, in_b, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler_column(a: Column, b: Column) -> Column:
    """Arrow batches; meant for distinct pairs of names."""
    return F.pandas_udf(_similar, "double")(a, b)


def _pair_score(t: Column, other: Column, similar: Column | None) -> Column:
    """Of normalised names.  They are single tokens, so the token-set ratio is their equality, which counts as overlap."""
    parts = [token_overlap(t, other), F.when(F.contains(t, other) | F.contains(other, t), CONTAINED).otherwise(0.0)]
    if similar is not None:
        parts.append(similar)
    return F.when((t == "") | (other == ""), 0.0).otherwise(F.greatest(*parts))


def containment_resolver(descriptor: Column, supplier: Column, hint: Column) -> Column:
    """Similarity by containment and token sets alone; every part is a built-in expression."""
    return F.greatest(_pair_score(descriptor, supplier, None), _pair_score(descriptor, hint, None))


def default_resolver(descriptor: Column, supplier: Column, hint: Column) -> Column:
    """Containment, token sets and Jaro-Winkler; the better of supplier and hint.

    Names that overlap as far as can be are not handed to Python.
    """

    def score(other: Column) -> Column:
        open_ = token_overlap(descriptor, other) < 1.0
        return _pair_score(descriptor, other, jaro_winkler_column(F.when(open_, descriptor), F.when(open_, other)))

    return F.greatest(score(supplier), score(hint))


#: Resolvers that take normalised names; any other gets the names as they are.
containment_resolver.normalised = True
default_resolver.normalised = True


def with_merchant_score(pairs: DataFrame, resolver, into: str = "merchant_score") -> DataFrame:
    """Score the distinct (descriptor, supplier, hint) triples and join the scores back.

    Pairs are many and triples few, the more so once names are normalised, so a costly
    resolver runs once per triple.  Nulls are folded to empty texts, which keeps the
    join an equi-join.
    """
    keys = ("__d", "__s", "__h")
    shape = normalise if getattr(resolver, "normalised", False) else lambda c: c
    # both are read twice; written tables also keep the optimizer from pushing the
    # scoring expression, with all its patterns, down to every pair
    keyed = pairs.withColumns({k: shape(F.coalesce(F.col(c), F.lit(""))) for k, c in zip(keys, ("merchant", "supplier", "raw_merchant_hint"), strict=True)})
    keyed = settle(keyed)
    triples = keyed.select(*keys).distinct()
    scored = settle(triples.select(*keys, resolver(*[F.col(k) for k in keys]).alias(into)))
    return keyed.join(scored, list(keys)).drop(*keys)


def mcc_corroboration(mcc: Column, supplier: Column, hint: Column) -> Column:
    """1 on a keyword hit, weak on none, neutral for an empty or unknown code."""
    text = F.lower(F.concat(F.coalesce(supplier, F.lit("")), F.lit(" "), F.coalesce(hint, F.lit(""))))
    out = F.lit(MCC_NEUTRAL)
    for code, words in MCC_KEYWORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(mcc == code, F.when(hit, 1.0).otherwise(MCC_WEAK)).otherwise(out)
    return F.when(F.coalesce(mcc, F.lit("")) == "", MCC_NEUTRAL).otherwise(out)

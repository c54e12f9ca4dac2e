"""String and vector similarity. All but Jaro-Winkler are Column expressions; that one is an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import text as X

#: Letters that an edit may swap without cost, and what stands for them.
ALIKE = ("صضطظحعاق", "سدتذهءءك")
#: Soundex digits of consonants; vowels, H, W and Y have none.
CODES = ("BFPVCGJKQSXZDTLMNRAEIOUHWY", "111122222222334556")


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro with transpositions in whole pairs; a common prefix counts where Jaro is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hits = list(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == ch:
                free[j] = None
                hits.append((ch, j))
                break
    if not hits:
        return 0.0
    there = [b[j] for j in sorted(j for _, j in hits)]
    swaps = sum(x != y for (x, _), y in zip(hits, there, strict=True)) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for p in zip(a, b, strict=True):
        if p not in seen:
            seen[p] = None if p[0] is None or p[1] is None else jaro_winkler_of(*p)
        out.append(seen[p])
    return pd.Series(out, dtype="float64")


def byte_bigrams(c: Column) -> Column:
    """The two-byte windows on character borders: pairs of one-byte characters and single two-byte ones."""
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.array(F.substring(c, i, F.lit(1)), F.substring(c, i, F.lit(2)))))
    return F.array_distinct(F.filter(grams, lambda g: F.octet_length(g) == 2))


def ngram_similarity(a: Column, b: Column) -> Column:
    x, y = byte_bigrams(a), byte_bigrams(b)
    union = F.size(F.array_union(x, y))
    short = (F.octet_length(a) < 2) | (F.octet_length(b) < 2)
    same = F.when(a == b, 1.0).otherwise(0.0)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).when(short, same).when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def soundex(c: Column) -> Column:
    """Soundex in which vowels, H, W and Y are passed over without a break between equal codes."""
    letters = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    first = F.translate(F.substring(letters, 1, 1), *CODES)
    runs = F.regexp_replace(F.concat(first, F.translate(F.substring(letters, F.lit(2), F.length(letters)), *CODES)), r"(\d)\1+", "$1")
    return F.when(letters == "", "0000").otherwise(F.concat(F.substring(letters, 1, 1), F.rpad(F.substring(runs, F.length(first) + 1, F.lit(3)), 3, "0")))


def phonetic_similarity(a: Column, b: Column) -> Column:
    x, y = soundex(a), soundex(b)
    same = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(0), lambda n, i: n + (F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))).cast("int"))
    return F.when(x == y, 1.0).otherwise(same / 4.0)


def arabic_edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.translate(a, *ALIKE), F.translate(b, *ALIKE))


def arabic_similarity(a: Column, b: Column) -> Column:
    x, y = X.normalize_for_matching(a), X.normalize_for_matching(b)
    most = F.greatest(F.length(x), F.length(y))
    edit = F.when(most == 0, 1.0).otherwise(1.0 - arabic_edit_distance(x, y) / most)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).when(x == y, 1.0).otherwise(F.greatest(edit, jaro_winkler(X.phonetic_key(x), X.phonetic_key(y))))


def medication_similarity(a: Column, b: Column) -> Column:
    x, y = X.normalize_for_matching(a), X.normalize_for_matching(b)
    jw, grams = jaro_winkler(x, y), ngram_similarity(x, y)
    arabic = arabic_similarity(x, y)
    standard = F.greatest(0.5 * jw + 0.3 * grams + 0.2 * phonetic_similarity(x, y), jw)
    return F.when(x == y, 1.0).when(X.contains_arabic(x) | X.contains_arabic(y), F.greatest(0.5 * arabic + 0.3 * jw + 0.2 * grams, arabic, jw)).otherwise(standard)


def weighted_similarity(a: Column, b: Column, weights: tuple[float, float, float]) -> Column:
    """Jaro-Winkler, bigrams and sound (for Arabic: its own similarity) by stated weights over their sum."""
    x, y = X.normalize_for_matching(a), X.normalize_for_matching(b)
    sound = F.when(X.contains_arabic(x) | X.contains_arabic(y), arabic_similarity(x, y)).otherwise(phonetic_similarity(x, y))
    parts = (jaro_winkler(x, y), ngram_similarity(x, y), sound)
    total = sum(weights)
    return sum((w * p for w, p in zip(weights[1:], parts[1:], strict=True)), weights[0] * parts[0]) / total if total else F.lit(0.0)


def arabic_phonetic_similarity(a: Column, b: Column) -> Column:
    return jaro_winkler(X.normalize_for_phonetic_matching(a), X.normalize_for_phonetic_matching(b))


def with_raw(parsed: Column, raw: Column) -> Column:
    """A similarity of parsed names held down by that of the raw ones."""
    return F.when(raw < 0.3, raw * 0.5).when(raw < 0.5, F.least(F.sqrt(parsed * raw), raw + 0.1)).otherwise(0.4 * parsed + 0.6 * raw)


def ensemble_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(X.normalize_arabic(a)), F.lower(X.normalize_arabic(b))
    return F.least(F.lit(1.0), jaro_winkler(x, y) + F.when(x.contains(y) | y.contains(x), 0.1).otherwise(0.0))


def resolver_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(most == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / most)


def word_trigrams(c: Column) -> Column:
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: X.trigrams(F.concat(F.lit("  "), w, F.lit(" "))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = word_trigrams(a), word_trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different or no length, 0 where one is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))

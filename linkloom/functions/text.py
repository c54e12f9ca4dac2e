"""Text normalisation, tokens and search-query text as Column expressions."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and marks that normalisation unifies or drops, letters that sound alike, digits.
MARKS = "ًٌٍَُِّْٰـ"
UNIFIED = ("أإآٱةى", "ااااهي")
SOUND = ("صضطظحعق", "سدتذهءك")
DIGITS = ("٠١٢٣٤٥٦٧٨٩", "0123456789")
DOSE = r"(?iU)\s+[\d٠-٩.,/]+\s*(ميكروغرام|مايكروجرام|جرام|غرام|ملغ|ملجم|وحدة|mcg|μg|ug|mg|ml|iu|ui|مل|ج|g|vial|tablet|ampoule)?\s*$"
#: Spellings of common names, by the spelling that stands for them.
SPELLINGS = {
    "اوجمنتين": "اوجمنتين اوغمنتين اوقمنتين اجمنتين",
    "بانادول": "بانادول باندول بنادول",
    "بروفين": "بروفين بروفن برفين",
    "اموكسيسيلين": "اموكسيسيلين اموكسسيلين اموكسيلين",
    "ميتفورمين": "ميتفورمين متفورمين ميتفرمين",
    "اوميبرازول": "اوميبرازول اومبرازول اوميبرزول",
    "اسبرين": "اسبرين اسبيرين اصبرين",
    "كتافلام": "كتافلام كاتافلام قتافلام",
    "فولتارين": "فولتارين فلتارين فولترين",
    "كونكور": "كونكور كنكور قونكور",
}


def mapping(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_arabic(c: Column) -> Column:
    return F.translate(c, UNIFIED[0] + MARKS, UNIFIED[1])


def contains_arabic(c: Column) -> Column:
    return c.rlike("[\\u0600-\\u06FF]")


def phonetic_key(c: Column) -> Column:
    return F.translate(normalize_arabic(c), *SOUND)


def normalize_for_matching(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(normalize_arabic(c)), DOSE, ""), r"(?U)\s+", " "))


def normalize_for_phonetic_matching(c: Column) -> Column:
    return phonetic_key(normalize_for_matching(c))


def canonical_name(c: Column) -> Column:
    key = F.regexp_replace(normalize_arabic(c), " ", "")
    return F.coalesce(F.element_at(mapping({v: k for k, vs in SPELLINGS.items() for v in vs.split()}), key), key)


def western_digits(c: Column) -> Column:
    return F.translate(c, *DIGITS)


def normalize_alias(c: Column) -> Column:
    return western_digits(F.lower(F.trim(c)))


def normalize_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def normalize_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def normalize_content(c: Column) -> Column:
    return F.lower(F.translate(c, "\n,.-", "    "))


def tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(normalize_content(c), r"\s+"), lambda w: F.length(w) > 2)))


def sanitize_token(c: Column) -> Column:
    return F.translate(c, "\"'*()^:+-~" + MARKS, "")


def trigrams(c: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
    return F.when(F.length(c) >= 3, grams).otherwise(F.array().cast("array<string>"))


def exact_query(c: Column, most: int = 50) -> Column:
    quoted = F.transform(F.slice(tokens(F.substring(c, 1, 10_000)), 1, most), lambda w: F.concat(F.lit('"'), sanitize_token(w), F.lit('"')))
    return F.array_join(quoted, " OR ")


def fuzzy_query(c: Column, most: int = 20) -> Column:
    ws = F.slice(F.filter(tokens(F.substring(c, 1, 10_000)), lambda w: F.length(w) >= 4), 1, most)
    grams = F.array_sort(F.array_distinct(F.flatten(F.transform(ws, lambda w: trigrams(sanitize_token(w))))))
    return F.array_join(F.transform(grams, lambda g: F.concat(F.lit('"'), g, F.lit('"'))), " OR ")


def language(c: Column) -> Column:
    arabic = F.regexp_count(c, F.lit("[\\u0600-\\u06FF]"))
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    share = arabic / letters
    return F.when(F.coalesce(letters, F.lit(0)) == 0, "unknown").when(share > 0.7, "arabic").when(share < 0.3, "english").otherwise("mixed")


def chat_user(c: Column) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(1))


def is_group_chat(c: Column) -> Column:
    return c.endswith("@g.us")


#: What may stand behind the @ of an address.
SERVERS = ("s.whatsapp.net", "g.us", "lid")


def valid_chat(c: Column) -> Column:
    """Whether an address has one @, something before it and a known server behind it."""
    parts = F.split(c, "@")
    return F.coalesce((F.size(parts) == 2) & (parts[0] != "") & parts[1].isin(*SERVERS), F.lit(False))


def phone_of(c: Column) -> Column:
    """What stands before the first @, the empty text without any."""
    return F.when(F.instr(c, "@") > 1, F.substring_index(c, "@", 1)).otherwise("")


def masked(c: Column, shown: int = 4) -> Column:
    """All but the last characters starred."""
    hidden = F.greatest(F.length(c) - shown, F.lit(0))
    return F.concat(F.repeat(F.lit("*"), hidden), F.substring(c, hidden + 1, F.length(c)))


def short_id(c: Column) -> Column:
    return F.substring(c, 1, 8)


def search_kind(c: Column) -> Column:
    """participant for what holds an @ or only digits, +, blanks and -, else text."""
    return F.when(c.contains("@") | c.rlike(r"^[0-9+ -]+$"), "participant").otherwise("text")


def split_issues(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    """Three bytes a token, as the offline estimate."""
    return F.ceil(F.octet_length(c) / 3)


def token_counter(vocabulary_path: str, pattern: str) -> Callable[[Column], Column]:
    """Tokens of a column under a byte-level vocabulary file of ranks, where tiktoken is installed; null texts have none."""
    with open(vocabulary_path, "rb") as f:
        raw = f.read()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0)

    return count

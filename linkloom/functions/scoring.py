"""Scores, bands and actions as Column expressions; `now` and all thresholds are parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import text as X

#: Milligrams in a unit, dosage forms by their name here, and what a pair of forms costs.
FRACTIONS = {"واحد ونص": 1.5, "واحد ونصف": 1.5, "نص": 0.5, "نصف": 0.5, "ربع": 0.25, "تلت": 0.33, "ثلث": 0.33, "اتنين": 2.0, "اثنين": 2.0, "تلاتة": 3.0, "ثلاثة": 3.0}
UNITS = {"mg": 1.0, "ملغ": 1.0, "ملجم": 1.0, "mcg": 0.001, "μg": 0.001, "ug": 0.001, "ميكروغرام": 0.001, "مايكروجرام": 0.001, "g": 1000.0, "ج": 1000.0, "جرام": 1000.0, "غرام": 1000.0, "ml": 1.0, "مل": 1.0, "iu": 1.0, "ui": 1.0, "وحدة": 1.0}
FORMS = {
    "امبول": "امبول أمبول ampoule amp",
    "فايل": "فايل vial",
    "اقراص": "اقراص أقراص قرص tablets tab tablet",
    "كبسولات": "كبسولات كبسولة capsules caps capsule",
    "شراب": "شراب syrup liquid سيرب",
    "نقط": "نقط نقطة drops drop",
    "لاصقه": "لاصقه لاصقة patch",
    "حقن": "حقن حقنة injection inj",
    "لبوس": "لبوس suppository supp",
    "جل": "جل gel",
    "كريم": "كريم cream",
    "مرهم": "مرهم ointment",
    "بخاخ": "بخاخ spray inhaler",
    "طقم": "طقم kit",
}
PENALTIES = {
    ("امبول", "فايل"): 0.1, ("اقراص", "كبسولات"): 0.2, ("امبول", "اقراص"): 0.8, ("امبول", "شراب"): 0.8, ("امبول", "كبسولات"): 0.8, ("فايل", "اقراص"): 0.8,
    ("فايل", "شراب"): 0.8, ("اقراص", "شراب"): 0.7, ("كبسولات", "شراب"): 0.7, ("حقن", "اقراص"): 0.8, ("حقن", "شراب"): 0.8, ("لبوس", "اقراص"): 0.7,
    ("لبوس", "شراب"): 0.7, ("لاصقه", "اقراص"): 0.7, ("كريم", "اقراص"): 0.8, ("مرهم", "اقراص"): 0.8, ("جل", "اقراص"): 0.8,
}
BANDS = (0.9, 0.7, 0.5)
WEIGHTS = {"medication": 0.6, "pharmaceutical": 0.2, "recency": 0.1, "ai": 0.1, "expiry": 0.0, "supplier": 0.0}


def age_hours(at: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / 60) / 60.0


def recency(hours: Column, half_life: float = 72.0, decay: str = "exponential") -> Column:
    """exponential: half at each half-life; linear: none at two; root: 0.1 at four and beyond."""
    if decay == "linear":
        out = F.greatest(F.lit(0.0), 1.0 - hours / (2 * half_life))
    elif decay == "root":
        out = F.when(hours >= 4 * half_life, 0.1).otherwise(F.greatest(F.lit(0.1), F.sqrt(F.greatest(F.lit(0.0), 1.0 - hours / (4 * half_life)))))
    else:
        out = F.pow(F.lit(0.5), hours / half_life)
    return F.when(hours <= 0, 1.0).otherwise(out)


def expiry_score(days: Column, near: int = 30) -> Column:
    return F.when(days.isNull(), 0.5).when(days < 0, 0.0).when(days <= near, days / float(near)).otherwise(1.0)


def enough_shelf_life(days: Column, least: int) -> Column:
    return F.coalesce(days >= least, F.lit(False))


def band(score: Column, at: tuple[float, float, float] = BANDS) -> Column:
    return F.when(score >= at[0], "Auto").when(score >= at[1], "Suggest").when(score >= at[2], "Review").otherwise("None")


def smooth_band(score: Column, at: tuple[float, float, float] = BANDS, width: float = 0.1) -> Column:
    """struct(band, confidence, strength, transition, boundary): within a tenth of a band from its ends confidence bends by t^2 (3 - 2t)."""
    auto, suggest, review = at
    bend = lambda t: t * t * (3.0 - 2.0 * t)

    def out(name: str, confidence: Column, strength: Column, inside: bool, edge: str | None) -> Column:
        return F.struct(F.lit(name).alias("band"), confidence.alias("confidence"), strength.alias("strength"), F.lit(inside).alias("transition"), F.lit(edge).cast("string").alias("boundary"))

    def zone(name: str, low: float, high: float, upper: bool) -> Column:
        w = (high - low) * width
        up, down = bend((high - score) / w), bend((score - low) / w)
        lower = F.when(score - low < w, out(name, low + (score - low) * down, down, True, "lower")).otherwise(out(name, score, F.lit(1.0), False, None))
        return F.when(high - score < w, out(name, score + (high - score) * (1.0 - up) * 0.5, up, True, "upper")).otherwise(lower) if upper else lower

    w = review * width
    up = bend((review - score) / w)
    none = F.when((review - score < w) & (score > 0), out("None", score * up, up, True, "upper")).otherwise(out("None", score, F.lit(1.0), False, None))
    return F.when(score >= auto, zone("Auto", auto, 1.0, False)).when(score >= suggest, zone("Suggest", suggest, auto, True)).when(score >= review, zone("Review", review, suggest, True)).otherwise(none)


def match_action(name: Column, automatic: bool = False) -> Column:
    return F.when((name == "Auto") & F.lit(automatic), "AutoConfirm").when(name.isin("Auto", "Suggest"), "Suggest").when(name == "Review", "Queue").otherwise("Ignore")


def parse_action(confidence: Column) -> Column:
    return F.when(confidence >= 0.6, "Accept").when(confidence >= 0.5, "QueueForReview").otherwise("Reject")


def concentration(c: Column) -> Column:
    """struct(value, unit, mg): the first number, the first unit behind a digit or blank, and both in milligrams; a text that is a number word has its value and no unit."""
    word = F.element_at(X.mapping(FRACTIONS), F.lower(F.trim(c)))
    flat = F.lower(X.western_digits(F.trim(c)))
    value = F.regexp_extract(flat, r"(\d+\.?\d*)", 1)
    unit = F.regexp_extract(flat, "(" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + ")", 1)
    number = F.when(value != "", value.cast("double"))
    named = F.struct(word.alias("value"), F.lit(None).cast("string").alias("unit"), word.alias("mg"))
    return F.when(word.isNotNull(), named).when(number.isNotNull(), F.struct(number.alias("value"), F.nullif(unit, F.lit("")).alias("unit"), (number * F.coalesce(F.element_at(X.mapping(UNITS), unit), F.lit(1.0))).alias("mg")))


def percent_difference(a: Column, b: Column) -> Column:
    least = F.least(a, b)
    return F.when((F.abs(a - b) < 0.001) | (least == 0), 0.0).otherwise(F.abs(a - b) / least * 100.0)


def form_name(c: Column) -> Column:
    flat = F.nullif(F.trim(F.lower(X.normalize_arabic(c))), F.lit(""))
    return F.coalesce(F.element_at(X.mapping({v: k for k, vs in FORMS.items() for v in vs.split()}), flat), flat)


def form_penalty(a: Column, b: Column) -> Column:
    x, y = form_name(a), form_name(b)
    rules = X.mapping({f"{p}|{q}": v for (p, q), v in PENALTIES.items()} | {f"{q}|{p}": v for (p, q), v in PENALTIES.items()})
    return F.when(x.isNull() | y.isNull() | (x == y), 0.0).otherwise(F.coalesce(F.element_at(rules, F.concat(x, F.lit("|"), y)), F.lit(0.3)))


def pharma_score(mg_a: Column, mg_b: Column, form_a: Column, form_b: Column, tolerance: float = 20.0, reject: float = 50.0) -> Column:
    d = percent_difference(mg_a, mg_b)
    dose = F.when(mg_a.isNull() & mg_b.isNull(), 0.0).when(mg_a.isNull() | mg_b.isNull(), 0.15).when(d > reject, 1.0).when(d > tolerance, 0.3 + (d - tolerance) / (reject - tolerance) * 0.7).otherwise(0.0)
    form = F.when(form_a.isNull() & form_b.isNull(), 0.0).when(form_a.isNull() | form_b.isNull(), 0.2).otherwise(form_penalty(form_a, form_b))
    return F.greatest(F.lit(0.0), (1.0 - dose) * (1.0 - form))


def match_score(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS, gate: float = 0.7) -> Column:
    total = sum((F.coalesce(parts[k], F.lit(0.0)) * w for k, w in weights.items() if k in parts), F.lit(0.0))
    return F.when(parts["medication"] < gate, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def normal_cdf(z: Column) -> Column:
    """Through erf by the polynomial 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return 0.5 * (1.0 + F.when(z < 0, -1.0).otherwise(1.0) * (1.0 - poly * F.exp(-x * x)))


def backoff_seconds(attempt: Column, base: int = 30) -> Column:
    return (base * F.pow(F.lit(2.0), attempt)).cast("long")


def half_life(category: Column, lives: dict[str, float], default: float = 72.0) -> Column:
    """Hours after which recency halves, by category; 1 at least."""
    return F.greatest(F.lit(1.0), F.coalesce(F.element_at(X.mapping(lives), category), F.lit(default)))


def normalized_weights(weights: list[Column]) -> list[Column]:
    """Weights that sum to 1; equal ones where all are 0."""
    total = sum(weights[1:], weights[0])
    return [F.when(total == 0, 1.0 / len(weights)).otherwise(w / total) for w in weights]


def weights_valid(weights: list[Column], tolerance: float = 0.01) -> Column:
    """Whether weights are from 0 to 1 and sum to 1 within the tolerance."""
    total = sum(weights[1:], weights[0])
    inside = weights[0].between(0, 1)
    for w in weights[1:]:
        inside &= w.between(0, 1)
    return inside & (F.abs(total - 1.0) <= tolerance)


def breakdown(parts: dict[str, tuple[Column, Column]]) -> Column:
    """array of struct(name, score, weight, share) of each part's score and weight."""
    return F.array(*[F.struct(F.lit(k).alias("name"), s.alias("score"), w.alias("weight"), (s * w).alias("share")) for k, (s, w) in parts.items()])


def retry_at(attempt: Column, at: Column, base: int = 30, most: int = 3) -> Column:
    """When a failed attempt is tried again, null once `most` have failed."""
    return F.when(attempt < most, F.timestamp_seconds(F.unix_timestamp(at.cast("timestamp")) + backoff_seconds(attempt, base)))


#: How much an urgency counts.
URGENCY = {"Low": 1, "Medium": 3, "High": 5, "Urgent": 8, "Critical": 10}


def priority(level: Column) -> Column:
    return F.coalesce(F.element_at(X.mapping(URGENCY), level), F.lit(1))


def fulfilment(offered: Column, requested: Column) -> Column:
    """How much of a quantity is offered: nothing under half of it, all from the whole on."""
    ratio = offered / requested
    return F.when(ratio < 0.5, 0.0).when(ratio > 1, 1.0).otherwise(ratio)


def percent_text(score: Column, label: str) -> Column:
    return F.format_string(f"{label}:%.0f%%", score * 100)


def in_schedule(minutes: Column, schedule: str) -> Column:
    """Whether a minute of the day lies in HH:MM-HH:MM, the start included and the end not, over midnight too; always, if that can't be read."""
    m = re.fullmatch(r"\s*(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})\s*", schedule)
    if not m or max(int(m[1]), int(m[3])) > 23 or max(int(m[2]), int(m[4])) > 59:
        return F.lit(True)
    a, b = int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4])
    return (minutes >= a) & (minutes < b) if a <= b else (minutes >= a) | (minutes < b)

"""Scalar functions on literal vectors and edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom.functions import json_repair as J
from linkloom.functions import scoring as Z
from linkloom.functions import similarity as Y
from linkloom.functions import splitting as P
from linkloom.functions import text as X


@pytest.fixture(scope="module")
def one(spark):
    return lambda *cols: tuple(spark.range(1).select(*cols).first())


def L(x):
    return F.lit(x)


def test_arabic_text(one):
    got = one(X.normalize_arabic(L("أَوجمنتينةى")), X.contains_arabic(L("x ب")), X.phonetic_key(L("صضطظحعق")), X.normalize_for_matching(L("Panadol  Extra 500mg ")), X.western_digits(L("١٥٠")), X.canonical_name(L("اوغ منتين")))
    assert got == ("اوجمنتينهي", True, "سدتذهءك", "panadol extra", "150", "اوجمنتين")
    assert one(X.language(L("بنادول")), X.language(L("abc")), X.language(L("123")), X.language(L(""))) == ("arabic", "english", "unknown", "unknown")
    assert one(X.trigrams(L("ab")), X.trigrams(L("abcd")), X.split_issues(L("Price mismatch; Quantity low; "))) == ([], ["abc", "bcd"], ["Price mismatch", "Quantity low"])


def test_similarities(one):
    f = lambda a, b: one(Y.medication_similarity(L(a), L(b)))[0]
    assert f("Aspirin", "aspirin") == f("Panadol 500mg", "Panadol") == f("أوجمنتين", "اوجمنتين") == 1.0
    assert f("Panadol", "Augmentin") < 0.6
    assert one(Y.ngram_similarity(L("test"), L("test")), Y.ngram_similarity(L("abc"), L("xyz")), Y.ngram_similarity(L(""), L("")), Y.ngram_similarity(L(""), L("a"))) == (1.0, 0.0, 1.0, 0.0)
    assert one(Y.soundex(L("Tymczak")), Y.soundex(L("")), Y.soundex(L("Robert"))) == ("T520", "0000", "R163")
    v = lambda *x: F.array(*map(L, x))
    assert one(Y.cosine(v(1.0, 0.0), v(-1.0, 0.0)), Y.cosine(v(0.0, 0.0), v(1.0, 0.0)), Y.cosine(v(1.0), v(1.0, 0.0))) == (-1.0, 0.0, None)
    assert Y.jaro_winkler_of("", "") == 1.0 and Y.jaro_winkler_of("a", "") == 0.0 and Y.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)


def test_bands_and_scores(one):
    assert one(*[Z.band(L(x)) for x in (0.90, 0.89, 0.69, 0.49)]) == ("Auto", "Suggest", "Review", "None")
    assert one(Z.recency(L(72.0)), Z.recency(L(-1.0)), Z.recency(L(144.0), decay="linear"), Z.recency(L(288.0), decay="root")) == (0.5, 1.0, 0.0, 0.1)
    assert one(Z.expiry_score(L(None).cast("int")), Z.expiry_score(L(-1)), Z.expiry_score(L(15)), Z.expiry_score(L(99))) == (0.5, 0.0, 0.5, 1.0)
    assert one(Z.concentration(L("١٥٠ mg"))["mg"], Z.concentration(L("2 g"))["mg"], Z.concentration(L("none"))) == (150.0, 2000.0, None)
    assert one(Z.percent_difference(L(150.0), L(15.0)), Z.percent_difference(L(0.0), L(5.0))) == (900.0, 0.0)
    assert one(Z.form_penalty(L("tablet"), L("أقراص")), Z.form_penalty(L("amp"), L("vial")), Z.form_penalty(L("x"), L("y")), Z.form_penalty(L(""), L("y"))) == (0.0, 0.1, 0.3, 0.0)
    assert one(Z.normal_cdf(L(0.0)))[0] == pytest.approx(0.5, abs=1e-6) and one(Z.normal_cdf(L(1.96)))[0] == pytest.approx(0.975, abs=1e-4)
    assert one(Z.match_score({"medication": L(0.69), "recency": L(1.0)}), Z.match_score({"medication": L(1.0), "pharmaceutical": L(1.0), "recency": L(1.0)}))[0] == 0.0


@pytest.mark.parametrize(
    ("text", "status", "value"),
    [
        ('{"a":1}', "strict_ok", {"a": 1}), ('{"a":1,}', "repaired", {"a": 1}), ('{"a":1', "repaired", {"a": 1}), ("{a: 'b'}", "repaired", {"a": "b"}),
        ("{“a”: “b”}", "repaired", {"a": "b"}), ('{"a":True,"b":None}', "repaired", {"a": True, "b": None}), ('x ```json\n{"a": [1 2, 3]}\n```', "repaired", None),
        ('{"a":1,"b":2, nonsense nonsense', "partial", {"a": 1, "b": 2}), ("no json", "failed", None), ("", "failed", None), (None, "failed", None),
        ('{"a": 1 /* c */, "b": [1, 2,], // d\n}', "repaired", {"a": 1, "b": [1, 2]}),
    ],
)
def test_json_repair(text, status, value):
    got = J.repair(text)
    assert got[0] == status
    if value is not None:
        assert json.loads(got[1]) == value and 0 < got[2] <= 1


def test_json_helpers():
    assert J.schema_score('{"a": 1}', ["a", "b"], {"a": "number"}) == 0.75 and J.schema_score("[1]", ["a"], {}) == 0.0
    assert J.patched("abcdef", [("replace", 0, 1, "X"), ("delete", 2, 4, ""), ("insert", 6, 6, "!")]) == "Xbef!"


def test_cutting():
    assert P.segments("hello available panadol need aspirin") == [(0, "Unknown", None, "hello"), (1, "Offer", "available", "panadol"), (2, "Request", "need", "aspirin")]
    assert P.segments("available") == [] and P.segments(" plain \n") == [(0, "Unknown", None, " plain \n")] and P.segments("") == [(0, "Unknown", None, "")]
    assert P.segments("need x\navailable") == [(0, "Request", "need", "x")]
    assert P.mixed("need x available y") and not P.mixed("need x need y")
    assert P.chunks("", 5) == [] and P.chunks("abc", 5) == ["abc"] and P.chunks("      ", 5) == ["      "]
    text = "aa bb cc\ndd" * 9
    assert all(len(c) <= 7 and c == c.strip() for c in P.chunks(text, 7)) and "".join(P.chunks(text, 7)).replace(" ", "") == text.replace(" ", "").replace("\n", "")
    assert P.line_chunks("a\nb\r\nc\nd\n", 3, 99) == ["a\nb\nc", "d"] and P.line_chunks("a\nb", 3, 99) == ["a\nb"] and P.line_chunks("a\n" * 9, 12, 99, depth=2) == ["a\na\na"] * 3


def test_number_words(one):
    assert [one(Z.concentration(L(x)))[0]["mg"] for x in ("واحد ونص", " نص ", "ربع", "ثلاثة")] == [1.5, 0.5, 0.25, 3.0]
    assert one(Z.concentration(L("نص 5 mg")))[0]["mg"] == 5.0


def test_schedules_and_weights(one):
    at = lambda s: [m for m in (0, 359, 360, 540, 1019, 1020, 1320) if one(Z.in_schedule(L(m), s))[0]]
    assert at("22:00-06:00") == [0, 359, 1320] and at("09:00-17:00") == [540, 1019] and len(at("9 to 5")) == len(at("24:00-25:00")) == 7 and at("08:00-08:00") == []
    assert one(*Z.normalized_weights([L(0.0), L(0.0)])) == (0.5, 0.5) and one(*Z.normalized_weights([L(1.0), L(3.0)])) == (0.25, 0.75)
    assert one(Z.weights_valid([L(0.5), L(0.5)]), Z.weights_valid([L(0.7), L(0.5)]), Z.weights_valid([L(-0.5), L(1.5)])) == (True, False, False)
    assert one(Z.fulfilment(L(4.0), L(10.0)), Z.fulfilment(L(5.0), L(10.0)), Z.fulfilment(L(15.0), L(10.0))) == (0.0, 0.5, 1.0)
    assert one(*[Z.priority(L(x)) for x in ("Low", "Medium", "High", "Urgent", "Critical", "odd")]) == (1, 3, 5, 8, 10, 1)
    assert one(Z.half_life(L("x"), {"x": 0.2}), Z.half_life(L("y"), {"x": 0.2})) == (1.0, 72.0) and one(Z.percent_text(L(0.876), "Med")) == ("Med:88%",)


def test_addresses(one):
    ok = [one(X.valid_chat(L(x)))[0] for x in ("1@s.whatsapp.net", "g@g.us", "z@lid", "", "a", "@g.us", "a@b@lid", "a@example.org", None)]
    assert ok == [True, True, True] + [False] * 6
    assert one(X.phone_of(L("20@s.whatsapp.net")), X.phone_of(L("@x")), X.phone_of(L("x"))) == ("20", "", "")
    assert one(X.masked(L("123456")), X.masked(L("12")), X.short_id(L("abcdefghij"))) == ("**3456", "12", "abcdefgh")
    assert one(*[X.search_kind(L(x)) for x in ("a@b", "+20 12-3", "panadol 500", "")]) == ("participant", "participant", "text", "text")


def test_token_counts(spark):
    P_ = pytest.importorskip("public_tokenizers")
    count = X.token_counter(P_.path("byte_bpe_50k.tiktoken"), P_.PATTERN)
    rows = spark.createDataFrame([("hello world",), ("",), (None,)], "t string").select(count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [2, 0, 0]


def test_beam_readings_are_ranked():
    from linkloom.functions import json_beam as B

    best = lambda x: [r["json"] for r in B.readings(x)][:1]
    assert best('{"a": 1, "b": [true, null]}') == ['{"a": 1, "b": [true, null]}'] and B.readings('{"a": 1}')[0]["cost"] == 0.0
    assert best("{a: 'x', b: True") == ['{"a": "x", "b": true}'] and best("[1 2 3") == ["[1, 2, 3]"] and best('{"a" 1}') == ['{"a": 1}'] and best("") == []
    several = B.readings('{"a": 1 "b": }')
    assert len(several) > 1 and several[0]["json"] == '{"a": 1, "b": null}' and sum(r["confidence"] for r in several) <= 1.001
    assert [r["confidence"] for r in several] == sorted((r["confidence"] for r in several), reverse=True)
    rows = [{"json": "x", "confidence": 0.5, "cost": 1.0, "dropped": d, "strings": 0, "closed": 0, "fixes": 1, "schema": s} for d, s in ((2, 0.0), (1, 0.0), (3, 1.0))]
    assert [r["dropped"] for r in B.ranked(rows)] == [3, 1, 2]
    assert len(B.readings("[" * 60)) >= 1

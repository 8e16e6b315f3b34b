"""Micro rows of the name and address rules."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import text as T


def one(spark, expression, *values, types="a string, b string"):
    row = (*values, *[None] * (2 - len(values)))
    return spark.createDataFrame([row], types).select(expression(F.col("a"), F.col("b")).alias("x")).first()["x"]


@pytest.mark.parametrize("word,expected", [("kolkata", "klkd"), ("calcutta", "klkd"), ("data", "td"), ("tata", "dd"), ("vishal", "ssl"), ("wishal", "wsl"), ("phone", "pn"), ("fone", "fn"), ("123", "123"), ("", "")])
def test_skeleton(spark, word, expected):
    assert one(spark, lambda A, Bc: T.skeleton(A), word) == expected


@pytest.mark.parametrize("word,expected", [("pub1ic", "public"), ("6urgaon", "gurgaon"), ("3m", "em"), ("24x7", "2axt"), ("1st", "1st"), ("560001", "560001")])
def test_deleet(spark, word, expected):
    assert one(spark, lambda A, Bc: T.deleet(A), word) == expected


def test_fold_keeps_vowel_signs(spark):
    assert one(spark, lambda A, Bc: T.fold(A), "É\u00a0Ñ") == "e n"
    assert one(spark, lambda A, Bc: T.fold(A), "\u0930\u093e\u091c\u094d") == "\u0930\u093e\u091c"


def test_is_latin(spark):
    assert one(spark, lambda A, Bc: T.is_latin(A), "Zürich 12") is True
    assert one(spark, lambda A, Bc: T.is_latin(A), "राज") is False
    assert one(spark, lambda A, Bc: T.is_latin(A), "ế") is False


def test_to_latin(spark):
    known = F.create_map(F.lit("राज"), F.lit("raj"))
    assert one(spark, lambda A, Bc: T.to_latin(A, known), "राज Foods") == "raj foods"
    assert one(spark, lambda A, Bc: T.to_latin(A), "ராஜ Foods").isascii()
    for native, latin in (("Αθήνα", "athena"), ("Москва", "moskva"), ("Йошкар-Ола", "ioshkar-ola"), ("بيت", "byt"), ("שלום", "shlvm"), ("각도 SA", "gagdo sa"), ("राज", "raaja"), ("কো", "ko"), ("カ", "ka")):
        assert one(spark, lambda A, Bc: T.to_latin(A), native) == latin
    tokyo, kyoto = (one(spark, lambda A, Bc: T.to_latin(A), x) for x in ("東京", "京都"))
    assert len(tokyo.split()) == 2 and tokyo.isascii() and tokyo.split()[1] == kyoto.split()[0]
    assert one(spark, lambda A, Bc: T.to_latin(A, known), "  Plain É ") == "  plain e "


def test_clean(spark):
    assert one(spark, lambda A, Bc: T.clean_nulls(A), "<NULL>, N/A road").split() == [",", "road"]
    assert one(spark, lambda A, Bc: T.clean_nulls(A), None) == ""


@pytest.mark.parametrize("raw,expected", [("foo dba bar", ["foo", "bar"]), ("x | www.acme.com", ["x", "acme"]), ("shop.co.in", ["shop"]), ("  ", ["  "]), ("", [""])])
def test_variants(spark, raw, expected):
    assert one(spark, lambda A, Bc: T.name_variants(A), raw) == expected


@pytest.mark.parametrize("name,expected", [("l l c", ["llc"]), ("a & b", ["a", "and", "b"]), ("joe's ca$h co", ["joes", "cash", "company"]), ("i b m 5 g", ["ibm", "5", "g"]), ("", [])])
def test_name_tokens(spark, name, expected):
    assert one(spark, lambda A, Bc: T.name_tokens(A), name) == expected


def test_core(spark):
    assert one(spark, lambda A, Bc: T.core(F.split(A, " ")), "the company") == ["the", "company"]
    assert one(spark, lambda A, Bc: T.core(F.split(A, " ")), "the acme company") == ["acme"]


def test_normal_name(spark):
    got = one(spark, lambda A, Bc: T.normal_name(T.name_variants(A)), "foo dba bar")
    assert got["full"] == "bar" and got["cores"] == ["foo", "bar"]


@pytest.mark.parametrize("part,expected", [("5th", ["5"]), ("apt12", ["apartment", "12"]), ("1056c", ["1056"]), ("first", ["1st"]), ("st 007", ["street", "007"])])
def test_address_tokens(spark, part, expected):
    assert one(spark, lambda A, Bc: T.address_tokens(F.array(A)), part) == expected


def test_states(spark):
    comps = lambda A, Bc: T.components_of(A, Bc)
    assert one(spark, comps, "1 main st, florida", "us") == ["1 main st", "fl"]
    assert one(spark, lambda A, Bc: T.address_tokens(comps(A, Bc)), "florida", "us") == ["floor"]
    assert one(spark, comps, "florida", "in") == ["florida"]


def test_scores():
    assert S.ratio("abcd", "abxd") == 75.0 and S.ratio("", "") == 100.0
    assert S.token_sort_ratio("b a", "a b") == 100.0
    assert S.token_set_ratio("a b c", "b a") == 100.0 and S.token_set_ratio("", "a") == 0.0
    assert S.partial_ratio("abc", "xxabcxx") == 100.0 and S.partial_ratio("", "a") == 0.0
    assert S.partial_token_set_ratio("a b", "b c") == 100.0
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("", "") == 1.0


def test_scores_against_force():
    import random

    rng = random.Random(3)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randint(0, 14))) for _ in "ab")
        assert S.lcs(a, b) == lcs(a, b) and S.ratio(a, b) == S.ratio(b, a)
        assert 0 <= S.token_set_ratio(a, b) <= 100
        if a and b:
            short, long = sorted((a, b), key=len)
            n = len(short)
            tries = [long[max(0, e - n) : e] for e in range(1, len(long) + 1)] + [long[s:] for s in range(len(long))]
            best = max(S.ratio(short, t) for t in tries if len(t) <= n)
            if len(a) != len(b):
                assert S.partial_ratio(a, b) == pytest.approx(best)

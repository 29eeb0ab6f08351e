import difflib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import similarity as S
from tallyloom.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("WHOLEFDS MKT #0523", "whole foods market"), ("WFM #0523", "whole foods"), ("STARBUCKS STORE 12345", "starbucks"), ("STARBUCKS #12345 SF CA", "starbucks"), ("DELTA AIR 0062234556778", "delta"), ("LYFT *RIDE SUN 9PM", "lyft"), ("UBER * TRIP", "uber"),
        ("AIRBNB * HMWM2ABCDE", "airbnb"), ("WEWORK 340 PINE ST SF", "wework"), ("DOORDASH*CHIPOTLE", "doordash"), ("INTUIT *QUICKBOOKS", "quickbooks"), ("COSTCO WHSE #0456", "costco"), ("TRADER JOE S #127", "trader joes"), ("SQ *WFM #1", "sq whole foods"),
        ("Amazon.com*12345", "amazon com 12345"), ("Whole Foods Market, LLC", "whole foods market"), ("The Café & Bar, Inc.", "café bar"), ("Starbucks", "starbucks"), ("", ""), ("12345", "12345"), ("A and The", ""),
    ],
)
def test_merchant(spark, name, want):
    assert one(spark, T.merchant(F.col("n")), n=name) == want


@pytest.mark.parametrize(("subject", "want"), [("Re: Lunch at Café!", "lunch at café"), ("FWD: re: Invoice $1,234.50", "re invoice"), ("  FW : hello ", "fw hello"), ("fw: hello", "hello"), ("$42.50", ""), ("Order #12-3", "order 12 3")])
def test_subject(spark, subject, want):
    assert one(spark, T.subject(F.col("s")), s=subject) == want


@pytest.mark.parametrize(("text", "want"), [("ssn 123-45-6789.", "ssn [SSN]."), ("card 4111 1111 1111 1111", "card [CC]"), ("call (415) 555-0101", "call[PHONE]"), ("415-555-0101", "[PHONE]"), ("me@x.org now", "[EMAIL] now"), (None, None)])
def test_masking(spark, text, want):
    assert one(spark, T.masked(F.col("t")), t=text) == want


def test_redaction_is_cut(spark):
    out = one(spark, T.redacted(F.lit("E"), F.col("m")), m="word " * 200 + "\nsecret")
    assert len(out) == 500 and out.endswith("...")
    assert one(spark, T.redacted(F.lit("E"), F.col("m")), m="token=abc eyJa.b.c") == "E: [REDACTED] [REDACTED]"


@pytest.mark.parametrize(("a", "b", "tolerance", "want"), [(1.0, 1.0, 0.0, True), (1.0, 1.01, 0.0, False), (100.0, 101.0, 0.01, True), (0.0, 0.0, 0.1, True), (0.0, 1.0, 0.1, False), (-100.0, -99.5, 0.01, True)])
def test_amounts(spark, a, b, tolerance, want):
    assert one(spark, T.amounts_agree(F.col("a"), F.col("b"), tolerance), a=a, b=b) is want


def test_date_window(spark):
    assert one(spark, T.within_days(F.col("a"), F.col("b"), 3), a="2026-03-01", b="2026-03-04") is True
    assert one(spark, T.within_days(F.col("a"), F.col("b"), 3), a="2026-03-01 23:59:00", b="2026-03-05 00:00:00") is False


def test_email_and_slug_and_key(spark):
    assert one(spark, T.email_address(F.col("e")), e=" Me@X.org ") == "me@x.org"
    assert one(spark, T.email_address(F.col("e")), e="nobody") is None
    assert one(spark, T.unknown_slug(F.col("n")), n="New Vendor Co") == "unknown_new_vendor_co"
    assert one(spark, T.fuzzy_key(F.lit("name"), F.lit("subject"), F.lit(0.866))) == "fuzzy:name->subject:0.87"
    assert one(spark, T.fuzzy_key(F.lit("subject"), F.lit("subject"), F.lit(1.0))) == "fuzzy:subject:1.00"
    assert one(spark, T.with_midnight(F.col("d")), d="2026-01-02") == "2026-01-02T00:00:00Z"
    assert float(one(spark, T.token_cost(F.lit("m"), F.lit(1000), {"m": 0.001}))) == 1.0


def test_common_subsequence_against_tables():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choice("abc ") for _ in range(draw.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert S.common(a, b) == t[-1][-1]


def test_weighted_ratio():
    assert S.weighted_ratio("starbucks", "starbucks") == 100
    assert S.weighted_ratio("", "x") == 0
    assert S.weighted_ratio("new york mets", "mets new york") == 95
    assert S.weighted_ratio("whole foods", "whole foods market weekly order") == 90
    assert S.weighted_ratio("acme", "zebra crossing") < 60
    assert S.weighted_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)


def test_sequence_ratio_is_not_symmetric():
    assert S.sequence_ratio("tide", "diet") != S.sequence_ratio("diet", "tide")
    assert S.sequence_ratio(" AWS ", "aws") == 1.0 and S.sequence_ratio(None, "x") == 0.0
    assert S.sequence_ratio("amazon web", "amazon") == round(difflib.SequenceMatcher(None, "amazon web", "amazon").ratio(), 3)



def test_scored_pairs(spark):
    pairs = spark.createDataFrame([("a b", "b a"), ("a b", "b a"), ("x", "y")], "l string, r string")
    got = S.scored_pairs(pairs, "l", "r").collect()
    assert sorted(round(r["score"], 2) for r in got) == [0.0, 0.95, 0.95]

"""Parser truth tables (FIXTURES.md section 3), one Spark job per table."""

import pytest
from pyspark.sql import functions as F

from catalytics.functions import parse
from catalytics.operators import retrieval as RT

NBSP = "5 000 vendus"


def run(spark, fn, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


PRICE = [  # input, A, B, C
    (None, None, None, None), ("N/A", None, None, None), ("n/a", None, None, None), ("", None, None, None),
    ("MAD 143.97", 143.97, 143.97, 143.97), ("143,97 MAD", 143.97, 14397.0, 143.97),
    ("MAD 1,234.56", None, 1234.56, None), ("MAD 1 234,56", None, 123456.0, None),
    ("$-5.00", None, 5.0, None), ("1.2.3", None, None, None), ("gratuit", None, None, None),
    ("1.5d", None, 1.5, None), ("inf", None, None, None),
]


@pytest.mark.parametrize("fn,col", [(parse.price_a, 1), (parse.price_b, 2), (parse.price_c, 3)])
def test_price_dialects(spark, fn, col):
    assert run(spark, fn, [r[0] for r in PRICE]) == [r[col] for r in PRICE]


def test_rating_dialects(spark):
    vals = [None, "N/A", "4.5", "4,5", "bon"]
    assert run(spark, parse.rating_a, vals) == [None, None, 4.5, 4.5, None]
    assert run(spark, parse.rating_b, vals) == [None, None, 4.5, None, None]


SALES = [  # input, A, B, C
    (None, 0, 0, None), ("N/A", 0, 0, None), ("5000 vendus", 5000, 5000, 5000),
    ("5 000 vendus", 5000, 5000, 5000), ("5,000 vendus", 5000, 5000, 5),
    ("1000+ vendus", 0, 1000, 1000), ("1 000+ vendus", 0, 1000, 1000), ("120 vendu(s)", 0, 120, 120),
    ("5.2k vendus", 0, 52000, 5), ("plus de 500 vendus", 500, 500, None), (NBSP, 0, 5000, 5000),
]


@pytest.mark.parametrize("fn,col", [(parse.sales_a, 1), (parse.sales_b, 2), (parse.sales_c, 3)])
def test_sales_dialects(spark, fn, col):
    assert run(spark, fn, [r[0] for r in SALES]) == [r[col] for r in SALES]


def test_discount(spark):
    assert run(spark, parse.discount, [None, "N/A", "promo", "-48%", "12.5%", "48,5%"]) == \
        [0.0, 0.0, 0.0, 48.0, 12.5, 48.0]


def test_badge(spark):
    vals = [None, "Livraison gratuite", "Le plus vendu", "x | Best Seller", "Choix d'AliExpress", "AliExpress Choice"]
    assert run(spark, parse.badge_flag, vals) == [0, 0, 1, 1, 1, 1]


def test_tri_bool(spark):
    assert run(spark, parse.tri_bool, ["True", "TRUE", "true", "False", "yes", "", None]) == \
        [True, True, True, False, None, None, None]


def test_absolutise(spark):
    got = run(spark, lambda c: parse.absolutise(c, base="https://b.example"), ["//h/p", "/p", "https://h/p", None])
    assert got == ["https://h/p", "https://b.example/p", "https://h/p", "N/A"]


def test_derived_discount(spark):
    df = spark.createDataFrame([(200.0, 150.0), (100.0, 150.0), (0.0, 0.0), (None, 5.0), (5.0, None)], "o double, p double")
    got = [r[0] for r in df.select(parse.derived_discount("o", "p")).collect()]
    assert got == [25.0, 0.0, 0.0, 0.0, 0.0]


def test_store_endpoint(spark):
    got = run(spark, parse.store_endpoint, ["shop.example.com", "shop.example.com/x?y", "", "/x"])
    assert got == ["https://shop.example.com/products.json", "https://shop.example.com/products.json", None, None]


def test_query_terms_and_category(spark):
    got = run(spark, lambda c: F.array_join(RT.query_terms(c), ","),
              ["show me some womens apparel", "shirt shirt", "what is the mérino wool"])
    assert got == ["womens,apparel", "shirt,shirt", "mérino,wool"]
    cats = run(spark, RT.category_phrase, ["shoes for running men", "for shoes, please", "nothing here"])
    assert cats == ["running men", None, None]

"""Acceptance rules of listing fields."""

from pyspark.sql import functions as F

from contactloom.operators import listing as L


def one(spark, schema, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, {schema}")
    return [r["v"] for r in df.select("n", column.alias("v")).orderBy("n").collect()]


def C(name):
    return F.col(name)


def test_listing_name(spark):
    rows = [
        (" Acme  Pty ", "/maps/place/Other/x", "child"),
        ("Results", "https://m.example.org/maps/place/B%C3%A4r+%26+Co/data", None),
        (" Results ", "/maps/place/100%+Juice/1", None),
        ("x", "/maps/place/Results/1", " Inner "),
        (None, "/other", "results"),
        (None, None, "y"),
        ("★★", None, None),
    ]
    want = ["Acme Pty", "Bär & Co", "100% Juice", "Inner", None, None, None]
    assert one(spark, "a string, b string, c string", rows, L.listing_name(C("a"), C("b"), C("c"))) == want


def test_detail_name(spark):
    rows = [
        ("Results for x", " Real ", "T", "F"),
        ("x", None, "Shop - Maps", "F"),
        (None, None, "Results - Maps", "F"),
        (None, None, "plain", "Results"),
        (None, None, None, None),
        ("y" * 101, "y" * 100, None, None),
    ]
    want = ["Real", "Shop", "F", "Unknown Business", "Unknown Business", "y" * 100]
    column = L.detail_name([C("a"), C("b")], C("t"), C("f"), " - Maps")
    assert one(spark, "a string, b string, t string, f string", rows, column) == want


def test_other_fields(spark):
    pair = "a string, b string"
    address = L.detail_address([C("a"), C("b")])
    assert one(spark, pair, [("5 Main St ", None), ("main st", "x Rd"), ("a", "b")], address) == ["5 Main St", "x Rd", "N/A"]
    website = L.detail_website([C("a"), C("b")])
    got = one(spark, pair, [("javascript:a.b", " x.com "), ("http://y.z", None), ("none", None)], website)
    assert got == ["x.com", "http://y.z", "N/A"]
    phone = L.detail_phone([("text", C("a")), ("link", C("b"))])
    assert one(spark, pair, [("call 5 ", "tel:1"), ("call", "tel: +1 "), ("call", "mailto:1")], phone) == ["call 5", "+1", "N/A"]
    rating = L.detail_rating([C("a"), C("b")])
    assert one(spark, pair, [("4.6 ", None), ("4.6 stars", "3.1"), ("5", None)], rating) == ["4.6", "3.1", "N/A"]
    reviews = L.review_count([C("a"), C("b")])
    fixed = L.review_count_fixed([C("a"), C("b")])
    rows = [("1,234 reviews", None), (None, "(56 reviews)"), ("Reviews", "none"), ("7 REVIEWS", "8review")]
    assert one(spark, pair, rows, reviews) == ["234", "56", "N/A", "8"]
    assert one(spark, pair, rows, fixed) == [1234, 56, None, 8]
    category = L.detail_category([C("a"), C("b")])
    assert one(spark, pair, [("", " Shop "), ("z" * 100, "y"), (None, None)], category) == ["Shop", "y", "N/A"]


def test_cap_counts_only_accepted(spark):
    listings = spark.createDataFrame(
        [("q", "old", 1), ("q", None, 2), ("q", "a", 3), ("q", "a", 4), ("q", "b", 5), ("q", "c", 6), ("r", "old", 7)],
        "search_query string, name string, arrival int",
    )
    stored = spark.createDataFrame([("old", "q")], "name string, search_query string")
    kept = L.accepted_per_query(listings, stored, 2, ["arrival"]).collect()
    assert sorted(r["arrival"] for r in kept) == [3, 5, 7]

"""Joins that count what they meet, and labels with their fallbacks."""

from spanforge.operators.matching import match_one, with_family


def test_one_none_or_many(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (1, "e")], "k int, x string")
    right = spark.createDataFrame([(1, "one"), (2, "two"), (2, "two"), (None, "null"), (9, "nine")], "k int, y string")
    got = sorted((r.x, r.y, r.reason) for r in match_one(left, right, ["k"], ["y"]).collect())
    assert got == [("a", "one", None), ("b", None, "ambiguous"), ("c", None, "missing"), ("d", None, "missing"), ("e", "one", None)]
    assert {r.reason for r in match_one(left, right.limit(0), ["k"], ["y"]).collect()} == {"missing"} and match_one(left.limit(0), right, ["k"], ["y"]).collect() == []


def test_labels_fall_back_in_order(spark):
    rows = [("typed", "d", "t", "by-type", 0, False), ("typed", "d", None, "by-label", 1, False), ("typed", "d", None, "later", 2, False), ("plain", "d", None, "plain", 0, False), ("seen", "d", None, "mapped", 0, True), ("seen", "e", None, None, 1, True)]
    dimension = spark.createDataFrame(rows, "table string, label string, type string, family string, place int, reviewed boolean")
    asked = [(0, "typed", "d", "t"), (1, "typed", "d", "u"), (2, "typed", "d", None), (3, "typed", "x", "t"), (4, "plain", "d", "t"), (5, "seen", "d", None), (6, "seen", "e", None), (7, "seen", "new", None), (8, "seen", None, None), (9, "nowhere", "d", None)]
    got = {r.i: (r.family, r.labels) for r in with_family(spark.createDataFrame(asked, "i int, table string, label string, type string"), dimension).collect()}
    assert got == {0: ("by-type", []), 1: ("by-label", []), 2: ("by-label", []), 3: (None, []), 4: ("plain", []), 5: ("mapped", ["d"]), 6: (None, ["e"]), 7: (None, ["~unrecognized"]), 8: (None, []), 9: (None, [])}

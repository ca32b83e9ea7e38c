"""Spelling by affix rules and collated order."""

from pyspark.sql import functions as F

from quirefold.operators import affixes, collation

RULES = [("S", "suffix", True, "y", "ies", "[^aeiou]y"), ("S", "suffix", True, "", "s", "[^sy]"), ("D", "suffix", False, None, "ed", "."), ("U", "prefix", True, "", "un", "."), ("I", "prefix", True, "i", "ki", "i")]


def known(spark, words, stems, rules=RULES):
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    table = spark.createDataFrame(rules, "flag string, kind string, cross boolean, strip string, add string, condition string")
    return {r.word for r in affixes.known_words(frame, spark.createDataFrame(stems, "stem string, flags array<string>"), table).collect()}


def test_forms_follow_from_stems(spark):
    stems = [("try", ["S", "U"]), ("play", ["S", "D"]), ("Lock", ["U", "D", "S"]), ("bare", None), (None, ["S"]), ("iron", ["I"]), ("lock", ["U"])]
    words = ["try", "tries", "untry", "untries", "trys", "play", "plays", "plaies", "played", "unplay", "UNLOCK", "Unlocks", "unlocked", "locked", "bare", "bares", "kiron", "kitry", "s", "", None, "lock", "lock"]
    assert known(spark, words, stems) == {"try", "tries", "untry", "untries", "played", "play", "UNLOCK", "Unlocks", "locked", "bare", "kiron", "lock"}
    assert known(spark, words, []) == set() and known(spark, [], stems) == set() and known(spark, ["try", "tries"], stems, []) == {"try"}


def test_unknown_words_are_counted(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("b",), ("as",), (None,), ("",)], "word string")
    rules = spark.createDataFrame([("S", "suffix", True, "", "s", ".")], "flag string, kind string, cross boolean, strip string, add string, condition string")
    assert {tuple(r) for r in affixes.unknown_by_affixes(frame, spark.createDataFrame([("a", ["S"])], "stem string, flags array<string>"), rules).collect()} == {("b", 2)}


def test_collated_order_and_search(spark):
    rows = [(1, "Zebra"), (1, "écran"), (1, "Ecran"), (1, "eau"), (1, "ÉCRAN"), (1, None), (2, "b"), (2, "B"), (None, "x")]
    frame = spark.createDataFrame(rows, "g int, w string")
    got = {(r.g, r.w): r["rank"] for r in collation.collated_ranks(frame, ["g"], "w").collect()}
    assert got == {(1, None): 1, (1, "eau"): 2, (1, "écran"): 3, (1, "Ecran"): 3, (1, "ÉCRAN"): 3, (1, "Zebra"): 4, (2, "b"): 1, (2, "B"): 1, (None, "x"): 1}
    strict = {(r.g, r.w): r["rank"] for r in collation.collated_ranks(frame, ["g"], "w", collation.READERS).collect()}
    assert strict[1, "eau"] < strict[1, "Ecran"] < strict[1, "écran"] < strict[1, "ÉCRAN"] < strict[1, "Zebra"]
    assert [r.r for r in frame.filter("g = 1 AND w IS NOT NULL").select(collation.collated_search(F.col("w"), F.lit("CRÁ")).alias("r")).collect()] == [False, True, True, False, True]

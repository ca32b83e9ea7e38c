import random
import unicodedata

from pyspark.sql import functions as F

from quirefold.functions import text
from quirefold.operators import evaluation


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_errors_are_edits_of_words(spark):
    rng = random.Random(5)
    words = ["a", "b", "ab", "é", "é", "\U0001f600", "中", ""]
    line = lambda n, known: " ".join(rng.choice(known) for _ in range(n))
    pairs = [(line(rng.randrange(9), words), line(rng.randrange(9), words)) for _ in range(400)] + [("", "a"), ("a", ""), (" ", "  "), (None, "a"), ("a", None), (None, None)]
    many = [str(k) for k in range(3000)]
    pairs += [(" ".join(many), " ".join(many[::2])), (line(300, many), line(280, many))]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "id long, r string, o string")
    got = {x.id: x.wer for x in frame.select("id", text.word_error_rate(F.col("r"), F.col("o")).alias("wer")).collect()}
    for k, (r, o) in enumerate(pairs):
        assert got[k] == (None if not r or o is None else distance(r.split(" "), o.split(" ")) / len(r.split(" "))), (r, o)


def test_normal_form_is_that_of_unicode(spark):
    rng = random.Random(6)
    marks = [*range(0x300, 0x370), 0x9, 0x1C, 0x1F, 0x85, 0xA0, 0x2001, 0x3000, 0x200B, *range(0x1100, 0x1113), *range(0x1161, 0x1176), 0x212B, 0xF900, 0x1D15E]
    texts = ["".join(rng.choice("aeiouAEncz ") + chr(rng.choice(marks)) * rng.randrange(3) for _ in range(8)) for _ in range(2000)] + ["", " ", "\x1c", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {x.id: x.n for x in frame.select("id", text.normalize_nfc(F.col("t")).alias("n")).collect()}
    assert all(got[k] == (None if t is None else " ".join(unicodedata.normalize("NFC", t).split())) for k, t in enumerate(texts))


def test_scores_need_no_python(spark):
    items = spark.sql("SELECT 'x' AS item, 'a  b' AS reference, 'a c' AS output, 1 AS reference_pages, 1 AS output_pages, array('A') AS reference_fonts, array('A') AS output_fonts, 1 AS reference_tables, 2 AS output_tables")
    for scored in (evaluation.score_recognition(items), evaluation.score_office(items)):
        assert "Python" not in scored._jdf.queryExecution().toString()
        assert [(r.cer, r.wer) for r in scored.collect()] == [(1 / 3, 0.5)]

import pytest

from quirefold.operators import review


def found(text):
    return [(f[0], f[4], f[5]) for f in review.review_text(text)]


def test_rules():
    assert len(review.RULES) == 135
    assert ("GRAMMAR_AGREEMENT", "Eles vai", "Eles vão") in found("Eles vai")
    assert ("DUPLICATE_WORD", "de de", "de") in found("casa de de pedra")
    assert ("ACCENTUATION", "NAO", "NÃO") in found("NAO sei")
    assert ("SPELLING", "Fasso", "Faço") in found("Fasso isso")
    assert ("PARONYM_CONTEXT", "Mandato de prisão", "Mandado de prisão") in found("Mandato de prisão")
    assert ("CRASE_USAGE", "dia à dia", "dia a dia") in found("o dia à dia")
    assert [f[6] for f in review.review_text("a nível de x")] == [["no âmbito de", "em termos de", "quanto a"]]


def test_context_and_protection():
    assert not found("ele publica hoje")
    assert ("ACCENTUATION", "publica", "pública") in found("a escola publica")
    assert not [f for f in found("o agente foi") if f[0] == "PARONYM_CONTEXT"]
    assert ("PARONYM_CONTEXT", "agente foi", "a gente foi") in found("agente foi")
    assert not found("houveram por bem decidir")
    assert not found("veja https://x.y/nao e nao@b.com {{nao}}")


def test_findings_never_overlap_and_apply():
    text = "Eles vai  ao mercado , mas nao sabe ."
    fs = review.review_text(text)
    assert all(a[3] <= b[2] for a, b in zip(fs, fs[1:], strict=False))
    with pytest.raises(ValueError):
        review.review_text("a" * 1_000_001)


def test_frames(spark):
    docs = spark.createDataFrame([(1, "nao sei  bem"), (2, None)], "doc_id long, text string")
    fs = review.review(docs)
    assert {r["category"] for r in fs.collect()} == {"ACCENTUATION", "REPEATED_WHITESPACE"}
    got = {r["doc_id"]: r for r in review.apply_findings(docs, fs).collect()}
    assert got[1]["text"] == "não sei bem" and got[1]["error"] is None
    merged = review.merge_findings(fs.select("doc_id", "start", "end"), fs.select("doc_id", (fs["start"] + 1).cast("int").alias("start"), (fs["end"] + 4).cast("int").alias("end")))
    assert merged.count() == 2


def test_spelling(spark):
    docs = spark.createDataFrame([(1, "the CAT sat x 42 a1 see http://zzz.q blarg blarg Word")], "doc_id long, text string")
    words = spark.createDataFrame([("the",), (" Sat ",), ("see",)], "word string")
    custom = spark.createDataFrame([("WORD",)], "word string")
    assert {(r["word"], r["count"]) for r in review.unknown_words(docs, words, custom).collect()} == {("blarg", 2)}


def test_texts_of_one_file_are_spread(spark):
    docs = spark.range(0, 100, 1, 1).selectExpr("id AS doc_id", "'a  b' AS text")
    assert review.review(docs).rdd.getNumPartitions() >= 8

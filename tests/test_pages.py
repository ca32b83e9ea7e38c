from pyspark.sql import functions as F

from quirefold.operators import geometry, html_blocks, segments


def test_alignment_and_regions():
    assert geometry.align([[0.9, 0.1], [0.1, 0.1]]) == [(0, 0), (1, 1)] or geometry.align([[0.9, 0.1], [0.1, 0.1]])
    assert geometry.align([[0.1, 0.95]]) == [(None, 0), (0, 1)]
    assert geometry.regions({(0, 0), (1, 0), (5, 5)}) == [(0, 0, 2, 1), (5, 5, 1, 1)]


def test_sensitive_search_and_rectangles(spark):
    pages = spark.createDataFrame([(1, 1, "call 529.982.247-25 or a@b.co"), (2, 1, None)], "doc_id long, page int, text string")
    found = geometry.sensitive_matches(pages, geometry.PRESETS["cpf"])
    assert [(r["start"], r["stop"], r["value"]) for r in found.collect()] == [(5, 19, "529.982.247-25")]
    slices = spark.createDataFrame([(1, 1, 0, 10, 0.0, 50.0, 100.0, 10.0, 10.0, 200.0, 100.0), (1, 1, 10, 29, 0.0, 70.0, 190.0, 10.0, 10.0, 200.0, 100.0)], "doc_id long, page int, first int, last int, x double, y double, width double, height double, font_size double, page_width double, page_height double")
    boxes = geometry.match_rectangles(found, slices).orderBy("line").collect()
    assert [(b["x"], b["width"]) for b in boxes] == [(25.0, 25.0), (0.0, 45.0)]


def test_segments_rebuild_the_text(spark):
    text = "One. Two three! http://a.b/c?d=1, four\r\n\tfive " + "x" * 900 + " six"
    for most in (2, 7, 50, 400):
        chunks = segments.translation_chunks(text, most, ("Two",))
        assert "".join(chunks) == text
        assert all(len(c) <= most or c.startswith("http") for c in chunks if c != "Two")
    docs = spark.createDataFrame([(1, "a\r\nb\n" + "c" * 9000)], "doc_id long, text string")
    parts = [r["segment"] for r in segments.line_segments(docs).orderBy("seq").collect()]
    assert "".join(parts) == "a\r\nb\n" + "c" * 9000 and max(map(len, parts)) == 4000


def test_placeholders_must_come_back(spark):
    df = spark.createDataFrame([("a {x} b %d",)], "v string").select(segments.mask_placeholders(F.col("v")).alias("m"))
    m = df.first()["m"]
    assert m["placeholders"] == ["{x}", "%d"]
    lost = spark.createDataFrame([("no sentinel", ["{x}"]), ("QFPLACEHOLDER0TOKEN QFPLACEHOLDER0TOKEN", ["{x}", "%d"])], "t string, p array<string>")
    assert all(r["r"]["error"] and r["r"]["text"] is None for r in lost.select(segments.restore_placeholders(F.col("t"), F.col("p")).alias("r")).collect())


def test_page_chunks(spark):
    pages = segments.pack_pages([(1, "a" * 300), (2, "b" * 300), (3, "c" * 1000)], target=700, overlap=100)
    assert [(a, b) for a, b, _ in pages] == [(1, 2), (3, 3), (3, 3)]
    frame = spark.createDataFrame([(1, 1, "x" * 10), (2, 1, "y" * 100), (2, 2, None)], "doc_id long, page_number int, text string")
    got = {r["doc_id"]: r for r in segments.chunk_pages(frame).collect()}
    assert got[1]["error"] and got[2]["first_page"] == 1 and got[2]["error"] is None


def test_citations_are_rewritten(spark):
    df = spark.createDataFrame([("a [p. 9] b [P. 1-7]  c", 3)], "t string, n int").select(segments.rewrite_citations("t", "n").alias("r"))
    assert df.first()["r"] == "a b [p. 1–3] c"


def test_html_blocks():
    html = "<html><head><title>T</title></head><h1>A &amp; b</h1><p>x <b>y</b></p><ol><li>one</li><li>two</li></ol><table><tr><th>h</th></tr><tr><td>c</td></tr></table><hr><pre> a\n b</pre><script>no</script>"
    assert html_blocks.html_blocks(html) == [("heading", 1, "A & b", False), ("paragraph", 0, "x y", False), ("item", 1, "1. one", False), ("item", 1, "2. two", False), ("row", 0, "h", True), ("row", 0, "c", False), ("rule", 0, "", False), ("preformatted", 0, " a\n b", False)]
    assert html_blocks.html_blocks("just text") == [("paragraph", 0, "just text", False)]
    assert html_blocks.html_blocks(None) == []


def test_sanitizer(spark):
    df = spark.createDataFrame([("<a href='javascript:x' onclick=\"y\">k</a><script>z</script><input type=text>",)], "h string").select(html_blocks.sanitized(F.col("h")).alias("s"), html_blocks.element_count(F.col("h")).alias("n"))
    assert (df.first()["s"], df.first()["n"]) == ("<a>k</a>", 2)


def test_translation_slot_keeps_placeholders(spark):
    from quirefold.operators.translation import translate

    docs = spark.createDataFrame([(1, "Hi {name}\nline two"), (2, "plain %d")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in translate(docs).collect()} == {1: "Hi {name}\nline two", 2: "plain %d"}
    lost = {r["doc_id"]: r for r in translate(docs, lambda s: s.str.replace("QF", "")).collect()}
    assert lost[1]["text"] is None and lost[1]["error"]

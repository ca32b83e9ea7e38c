"""Worked examples: the scalar queries on typed-in rows, held against their SQL in DuckDB."""

import duckdb
import pytest

from quirefold.queries.common import Rows
from quirefold.queries.scalars import FUNCTIONS

DIGITS = Rows("v string", [("52998224725",), ("52998224726",), ("11111111111",), ("11222333000181",), ("11222333000182",), ("00000000000000",), ("123",), ("39053344705",), ("04252011000110",)])
NUMERALS = Rows("v string", [("I",), ("IV",), ("ix",), ("XLII",), ("MCMXCIV",), ("MMXXVI",), ("DCCC",), ("XC",)])
INDEXES = Rows("n long", [(k,) for k in (0, 1, 25, 26, 27, 51, 52, 701, 702, 703, 18277)])
CELLS = Rows("v string", [(x,) for x in ("R$ 1.234,56", "-R$ 10", "R$ -7,5", "-R$ -7", "12,5%", "50 %", "31/12/2024", "30/02/2024", "01/01/1899", "007", "1,234.56", "1.234", "123456789012345678", "abc", "", " 42 ", "-3.25", "0,5")])
GUARDED = Rows("v string", [("=1+1",), ("-5",), ("-5a",), ("@x",), ("+3",), ('say "hi"',), ("a,b",), ("plain",), ("  =x",)])
CASED = Rows("source string, target string", [("ABC", "xyz"), ("Abc", "xyz"), ("abc", "xyz"), ("", "xyz"), ("É", "ão"), ("Éa", "ão"), ("1a", "b")])
UNTRUSTED = Rows("v string", [("  a<system>b</system >\r\n\r\n\r\n\r\n\r\nc    d  ",), ("< user x>hi",), ("plain\rtext",), ("<systematic>",)])
SPANS = Rows("a int, b int", [(1, 1), (2, 5), (10, 11)])
LINES = Rows("v string", [("  a\tb\n",), ("x\x07y",), ("plain",), ("",)])
BOXES = Rows("id int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double", [(1, 0.1, 0.1, 0.5, 0.1, 0.5, 0.3), (2, -0.005, 0.2, 1.005, 0.2, 0.5, 0.4), (3, 0.1, 0.1, 0.1, 0.2, 0.1, 0.3), (4, -0.5, 0.0, 0.5, 0.5, 0.2, 0.2)])
PAIRS = Rows("reference string, output string", [("kitten", "sitting"), ("one two three", "one too three"), ("abc", ""), ("same", "same"), ("a b c d", "b c d e")])
TRANSLATED = Rows("source string, output string, names array<string>", [("Ana paid 1.234,56 on 3 May", "Ana pagou 1,234.56 em 3 de maio", ["Ana"]), ("Bob has 7 cats", "Bob tem gatos", ["Bob", "Eve"]), ("none", "nenhum", [])])
NEGATED = Rows("source string, a string, output string, b string", [("Eu não vou", "pt", "I won't go", "en"), ("Eu vou", "pt", "I go", "en"), ("No voy nunca", "es", "Eu vou", "pt"), ("Je ne vais pas", "fr", "I do not go", "en"), ("nothing, NEVER", "en", "nada", "es")])
UNITS = Rows("ocr_pages long, characters long, office_files long", [(1, 0, 0), (15, 0, 0), (0, 5000, 0), (0, 1, 0), (0, 0, 1)])
KEYS = Rows("member string, key string", [("m1", "k1"), ("m1", "k2"), ("ü", "")])
IMAGES = Rows("w long, h long, want_w long, want_h long", [(4000, 3000, 800, 800), (3000, 4000, 800, 800), (100, 50, None, 200), (100, 50, 30, None), (640, 480, None, None)])
CROPS = Rows("x double, y double, w double, h double, before long, after long", [(0.0, 0.0, 10.0, 10.0, 1000, 400), (95.4, 0.0, 5.0, 10.0, 0, 0), (-1.0, 0.0, 5.0, 5.0, 7, 9)])
RANGES = Rows("v string, n long", [("1-3,5", 10), ("5, 2-1 ,2", 10), ("", 10), ("1-", 10), ("0", 10), ("11", 10), ("a", 10), ("7 - 9", 9)])
REGIONS = Rows("page int, x double, y double, w double, h double", [(1, 0.0, 0.0, 1.0, 1.0), (0, 0.1, 0.1, 0.2, 0.2), (1, 0.9, 0.1, 0.2, 0.1), (2, -0.1, 0.1, 0.2, 0.2), (3, 0.2, 0.2, 0.0, 0.5)])
SELECTORS = Rows("selector string, mime string", [("TEXT_RANGE", "text/plain"), ("TEXT_RANGE", "application/pdf"), ("PDF_REGION", "application/pdf"), ("OCR_LINE", "application/vnd.ocr+json"), ("OTHER", "text/plain")])
TOOLS = Rows("id string, surfaces array<string>, capabilities array<string>", [("a", ["launcher"], ["gpu"]), ("b", ["launcher", "flow"], []), ("c", ["flow"], ["net", "gpu"])])
CITED = Rows("doc_id long, text string, total_pages int", [(1, "a [p. 1] b [P. 2-4] c [p. 1]", 3), (2, "[p. 9] [p. 2–1]", 5), (3, "none", 2)])
HEADINGS = Rows("text string, size double, bold boolean", [("Big", 20.0, False), ("Mid", 14.5, False), ("Small", 13.0, False), ("Bold", 11.0, True), ("Body text.", 20.0, True), ("body", 11.0, False)])
PLACED = Rows("doc_id long, page int, x double, y double, width double, height double, font_size double, bold boolean, str string, page_width double, page_height double", [(1, 1, 10.0, 20.0, 30.0, 10.0, 10.0, False, "a", 100.0, 100.0), (1, 1, 60.0, 20.0, 30.0, 10.0, 10.0, False, "b", 100.0, 100.0), (1, 1, 30.0, 50.0, 40.0, 10.0, 10.0, True, "c", 100.0, 100.0), (1, 1, 10.0, 90.0, 10.0, 0.0, 12.0, False, "d", 100.0, 100.0)])
GRID = Rows("doc_id long, page int, x double, y double, width double, height double, font_size double, bold boolean, str string, page_width double", [(1, 1, float(40 + 150 * c), float(50 + 20 * r), 60.0, 10.0, 10.0, r == 0, f"r{r}c{c}", 600.0) for r in range(4) for c in range(3) if (r, c) != (2, 1)] + [(1, 1, 40.0, 20.0, 300.0, 16.0, 18.0, True, "Title of the page", 600.0)])
PDFS = Rows("id int, signed boolean, total long, images long, image_bytes long, streams boolean", [(1, True, 100, 1, 50, False), (2, False, 0, 0, 0, False), (3, False, 5000, 0, 0, True), (4, False, 5000, 0, 0, False), (5, False, 100000, 3, 80000, False), (6, False, 100000, 3, 1000, True)])
HELD = Rows("participant string, period string, state string, maximum_micros long, actual_micros long", [("a", "2026-01", "settled", 100, 80), ("a", "2026-01", "queued", 50, None), ("b", "2026-01", "cancelled", 70, None), ("b", "2026-02", "running", 250000, None)])
JOBS = Rows("job_id string, state string, enqueued_at long, lease_until long, external_started boolean, unknown_since long", [("a", "queued", 900, 0, False, None), ("b", "queued", 600, 0, False, None), ("c", "running", 0, 1500, False, None), ("d", "running", 0, 500, True, None), ("e", "running", 0, 500, False, None), ("f", "needs_reconciliation", 0, 0, True, 300), ("g", "needs_reconciliation", 0, 0, True, 900), ("h", "settled", 0, 0, False, None)])
QUOTES = Rows("id int, expires_at long, policy_version string, bytes long, max_bytes long, expanded_bytes long, found_mime string, mime string, found_units string, units string, found_maximum long, maximum long", [(1, 50, "p", 1, 9, 1, "a", "a", "u", "u", 1, 1), (2, 500, "p", 10, 9, 1, "a", "a", "u", "u", 1, 1), (3, 500, "p", 1, 9, 101, "a", "a", "u", "u", 1, 1), (4, 500, "p", 1, 9, 1, "b", "a", "u", "u", 1, 1), (5, 500, "p", 1, 9, 1, "a", "a", "u", "u", 2, 1), (6, 500, "p", 1, 9, 1, "a", "a", "u", "u", 1, 1), (7, 500, "old", 1, 9, 1, "a", "a", "u", "u", 1, 1)])
LOG = Rows(
    "seq long, at long, action string, job_id string, participant string, maximum long, ocr_pages long, characters long, office_files long, fingerprint string, lease long, fence int, actual long",
    [
        (1, 1767300000, "reserve", "j1", "a", 1000, 1, 0, 0, "f1", 0, 0, 0),
        (2, 1767300001, "reserve", "j1", "a", 1000, 1, 0, 0, "f1", 0, 0, 0),
        (3, 1767300002, "reserve", "j1", "a", 1000, 2, 0, 0, "f2", 0, 0, 0),
        (4, 1767300003, "reserve", "j2", "a", 1000, 1, 0, 0, "f3", 0, 0, 0),
        (5, 1767300004, "claim", "j1", "a", 0, 0, 0, 0, "", 120, 0, 0),
        (6, 1767300005, "reserve", "j3", "b", 300000, 0, 100, 0, "f4", 0, 0, 0),
        (7, 1767300200, "claim", "j1", "a", 0, 0, 0, 0, "", 120, 0, 0),
        (8, 1767300210, "started", "j1", "a", 0, 0, 0, 0, "", 0, 2, 0),
        (9, 1767300220, "settle", "j1", "a", 0, 0, 0, 0, "", 0, 0, 700),
        (10, 1767300221, "settle", "j1", "a", 0, 0, 0, 0, "", 0, 0, 700),
        (11, 1767300222, "settle", "j1", "a", 0, 0, 0, 0, "", 0, 0, 701),
    ],
)
MATRIX = Rows("run long, engine_order int, item_order int, engine string, item string, cloud boolean, private boolean, estimate long, cost long", [(1, 0, k, "local", f"i{k}", False, k == 1, None, None) for k in range(3)] + [(1, 1, 0, "cloud", "i0", True, False, 3_000_000, 2_900_000), (1, 1, 1, "cloud", "i1", True, True, 1, None), (1, 1, 2, "cloud", "i2", True, False, 2_200_000, None), (1, 1, 3, "cloud", "i3", True, False, None, None)])
SCORED = Rows("engine string, kind string, item string, seq int, status string, cold boolean, ms double, cer double, wer double, failures int, cost_micros long", [(e, "ocr", f"i{k}", k, "error" if k == 11 and e == "b" else "skipped" if k == 10 else "ok", k == 0, 100.0 + 7 * k * (1 + (e == "b")), (0.05 if e == "a" else 0.03) * (k % 3), 0.1 * (k % 2), k % 5 == 0 and e == "a", 10 * k) for e in ("a", "b") for k in range(14)])
SCORED.rows = [(*r[:9], int(r[9]), r[10]) for r in SCORED.rows]
HYBRID = Rows("doc_id long, page int, native string, recognized string", [(1, 1, "long native text of more than thirty characters", "x"), (1, 2, "short", "a longer recognised text"), (1, 3, "", None), (1, 4, "short", "tiny")])
STREAM = Rows("doc_id long, page int, seq int, y double, str string", [(1, 1, 0, 10.0, "a"), (1, 1, 1, 12.0, "b"), (1, 1, 2, 20.0, "c"), (1, 2, 0, 5.0, "d")])
MASKED = Rows("v string", [("Hi {name}, see https://x.y/z and %(n)s or %d",), ("nothing",), ("{{a}}{b}",)])
EPOCHS = Rows("at long", [(1767225599,), (1767254399,), (1767254400,), (1772323199,), (1772352000,), (1785567599,)])
SCORES = Rows("pair_id long, left_page int, right_page int, similarity double", [(1, a, b, s) for a, row in enumerate([[0.9, 0.1, 0.2], [0.1, 0.1, 0.8]], 1) for b, s in enumerate(row, 1)])
ALIGNED = Rows("seq int, left_page int, right_page int, left_text string, right_text string, changed_pixels long, geometry_changed boolean", [(0, 1, 1, "a", "a", 0, False), (1, 2, None, "b", None, None, None), (2, None, 2, None, "c", None, None), (3, 3, 3, "d", "e", 0, False), (4, 4, 4, "f", "f", 9, False)])
PIXELS = Rows("page_id long, x int, y int", [(1, x, y) for x, y in ((0, 0), (1, 1), (90, 90), (91, 92), (50, 10), (54, 10))])
FILES = Rows("batch_id int, size long, before long, after long", [(1, 10, 100, 60), (1, 600_000_000, 50, 50), (2, 5, 0, 0)])
ANSWERS = Rows("response_id int, source_characters int, translations array<string>", [(1, 5, ["ol\u00e1"]), (2, 5, ["a", "b"]), (3, 5, ["  "]), (4, 0, [" "]), (5, 5, ["x\x07"]), (6, 5, ["y" * 30])])
RECOGNIZED = Rows(
    "response_id int, expected_pages int, text string, pages array<struct<number: int, lines: array<struct<segments: array<struct<start: int, end: int>>, confidence: double, vertices: array<struct<x: double, y: double>>>>>>",
    [
        (1, 1, "hello world", [(1, [([(0, 5)], 0.9, [(0.1, 0.1), (0.5, 0.1), (0.5, 0.2)]), ([(5, 6)], 0.9, []), ([(6, 11)], 0.8, [(0.0, 0.3), (1.005, 0.3), (1.0, 0.4)])])]),
        (2, 2, "x", [(1, [([(0, 1)], 0.5, [(0.1, 0.1), (0.5, 0.1), (0.5, 0.2)])])]),
        (3, 1, "x", [(1, [([(0, 9)], 0.5, [(0.1, 0.1), (0.5, 0.1), (0.5, 0.2)])])]),
    ],
)
OCR = Rows("item string, reference string, output string", [("a", "Total 12 e 30", "Total 12 e 3O"), ("b", "", "x"), ("c", "a\u0301gua  boa", "\u00e1gua boa")])
LETTERS = Rows("item string, source string, source_language string, output string, output_language string, names array<string>", [("a", "Ana n\u00e3o tem 3 gatos", "pt", "Ana has 3 cats", "en", ["Ana"]), ("b", "Bob has 2 dogs", "en", "Ele tem c\u00e3es", "pt", ["Bob"])])
OFFICE = Rows("item string, reference string, output string, reference_pages int, output_pages int, reference_fonts array<string>, output_fonts array<string>, reference_tables int, output_tables int", [("a", "one two", "one two", 3, 3, ["B", "A"], ["A"], 2, 1), ("b", "one two", "one", 3, 2, [], [], 0, 0)])

EXAMPLES = {
    "g1_g2_check_digits": DIGITS,
    "g3_roman_numerals": NUMERALS,
    "g8_column_letters": INDEXES,
    "g7_typed_cells": CELLS,
    "a13_guarded_csv_cells": GUARDED,
    "g11_match_case": CASED,
    "g12_sanitized_texts": UNTRUSTED,
    "g13_page_citations": SPANS,
    "g14_clean_lines": LINES,
    "g15_polygon_boxes": BOXES,
    "g17_character_error_rate": PAIRS,
    "g17_word_error_rate": PAIRS,
    "g18_missing_numbers_and_names": TRANSLATED,
    "g19_negation_status": NEGATED,
    "g21_price_estimates": UNITS,
    "g23_idempotency_ids": KEYS,
    "g24_resized_images": IMAGES,
    "g24_crops_and_savings": CROPS,
    "b8_page_ranges": RANGES,
    "b7_region_predicates": REGIONS,
    "b6_selector_types": SELECTORS,
    "b3_b4_tool_availability": TOOLS,
    "h21_citations": CITED,
    "i9_heading_levels": HEADINGS,
    "i5_region_filter": PLACED,
    "i1_i4_page_tables": GRID,
    "i7_i10_page_markdown": GRID,
    "i19_page_paragraphs": GRID,
    "f12_gap_sweep": GRID,
    "m_savings_range": PDFS,
    "k4_usage": HELD,
    "d9_running_counts": HELD,
    "k5_k6_k8_sweep": JOBS,
    "k10_finalize": QUOTES,
    "k2_k3_k5_ledger": LOG,
    "l2_run_gates": MATRIX,
    "d5_d6_l3_summary": SCORED,
    "c3_l4_paired_verdict": SCORED,
    "l6_summary_rows": SCORED,
    "a10_hybrid_pages": HYBRID,
    "a9_page_text": STREAM,
    "h17_placeholders": MASKED,
    "g22_billing_periods": EPOCHS,
    "c7_i13_aligned_pages": SCORES,
    "i15_page_status": ALIGNED,
    "i14_changed_regions": PIXELS,
    "d10_batch_totals": FILES,
    "d10_result_totals": FILES,
    "i17_translation_responses": ANSWERS,
    "i16_recognition_responses": RECOGNIZED,
    "l1_recognition_scores": OCR,
    "l1_translation_scores": LETTERS,
    "l5_office_scores": OFFICE,
    "h20_prompts": UNTRUSTED,
}


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([list(r[k]) if isinstance(r[k], (list, tuple)) else r[k] for k in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example(spark, name):
    make, sql = FUNCTIONS[name]
    got = make(EXAMPLES[name].frame(spark))
    rows = got.collect()
    assert rows
    if sql:
        want = duckdb.sql(sql.replace("$rows", EXAMPLES[name].sql))
        assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())

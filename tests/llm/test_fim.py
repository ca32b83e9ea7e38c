"""Fill-in-middle: rank and select over words, cuts, forms, restored texts."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import fim


def expected(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    """By lists of units."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="\n\n\x0a\x8a\rĊaé漢😀\x00", max_size=40), min_size=1, max_size=6), st.sampled_from(["line", "char"]))
def test_cuts_after_every_unit(texts, unit):
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    units = fim.Units(data, bounds[:-1], bounds[1:], unit)
    lists = [re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t) for t in texts]
    assert units.count.tolist() == [len(x) for x in lists]
    for k in range(max(map(len, lists)) + 1):
        wanted = [b + len("".join(x[:k]).encode()) for b, x in zip(bounds, lists)]
        found = units.cut(np.array([min(k, len(x)) for x in lists]))
        assert found.tolist() == wanted
        assert (units.chars.rank(found) - units.chars.rank(bounds[:-1])).tolist() == [len("".join(x[:k])) for x in lists]


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a\nb\nc"), (6, "a\nb\nc"), (None, "a\r\nb\n"), (None, "a\r\nb\n"),
    (7, "has <P> in it\nand more"), (8, "ends with <\n<S\n<"), (9, "x<M>"), (10, "漢字\n😀é\n" * 50), (11, "word " * 300_000), (12, "l\n" * 200_000), (13, "<\n" * 9), (14, "S>\n<P\n" * 9),
]


@pytest.mark.parametrize(("unit", "seed", "rate", "spm"), [("line", 7, 100, 50), ("char", 3, 60, 0)])
def test_rows_match_lists_of_units(spark, docs_of, unit, seed, rate, spm):
    rows = ODD + [(k, f"{k}\nb c\nd\n\ne") for k in range(100, 160)]
    found = fim.fill_in_middle(docs_of(rows), unit, seed, rate, spm)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted((expected(i, t, unit, seed, rate, spm) for i, t in rows), key=repr)
    assert {r[2] for r in got} == ({"plain", "psm", "spm"} if spm else {"plain", "psm"})


def test_report_restores_every_text(spark, docs_of):
    got = sorted((tuple(r) for r in fim.fim_report(docs_of(ODD)).collect()), key=repr)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted(((*expected(i, t)[:5], digest(expected(i, t)[5]), digest(t or "")) for i, t in ODD), key=repr)


def test_own_sentinels(spark, docs_of):
    long = fim.Sentinels("<|pre|>", "<|suf|>", "<|mid|>")
    rows = [(k, "a <P> b\n<|pre\nc <S> d\n<|") for k in range(40)]
    found = fim.fill_in_middle(docs_of(rows), sentinels=long)
    back = found.select(fim.restored(found.output, found.form, long).alias("t"), "form").collect()
    assert {r.t for r in back} == {rows[0][1]} and {r.form for r in back} == {"psm", "spm"}


def test_empty_table(spark, docs_of):
    assert fim.fim_report(docs_of([])).collect() == []
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(docs_of([]), unit="byte")

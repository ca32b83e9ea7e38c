"""Token files: codes, files, tokenizing by words, read-back."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirefold.llm import tokens
from quirefold.llm.common import load

VOCABULARY = tokens.word_bpe()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(VOCABULARY)


def expected(plain, rows, end_id=1):
    """doc_id, start, n_tokens, crc32: one text after the other, by the library alone."""
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1), st.sampled_from([0xFF, 0x100, 0xFFFF, 0x10000, 0xFFFFFF, 0x1000000])), max_size=70))
def test_codes_round_trip(values):
    ranks = np.array(values, dtype=np.uint32)
    control, data = tokens.encode(ranks)
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert tokens.decode(control, data, len(values)).tolist() == values


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x0c\r\x1c\x1f\x85\xa0 　aeEΣσİ̧́'st<|>1漢😀\x00"), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_words_have_the_ids_of_texts(texts):
    plain = Tokenizer.from_file(VOCABULARY) if not hasattr(test_words_have_the_ids_of_texts, "plain") else test_words_have_the_ids_of_texts.plain
    test_words_have_the_ids_of_texts.plain = plain
    texts = [*texts, "it's  <|endoftext|>x <|startoftext|> é ́a\n's"]
    ids, lengths = tokens.WordTable(VOCABULARY).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_most_frequent_ids_take_one_byte(tmp_path):
    out = tokens.TokenFile()
    ids = np.array([40_000] * 1000 + list(range(300)) * 2 + [7], dtype=np.uint32)
    out.add(np.array([5]), np.array([False]), ids, np.array([len(ids)]))
    path = f"file://{tmp_path}/x y.tok"
    assert out.write(path)[:2] == (1, len(ids))
    found = tokens.OpenTokens(path)
    assert found.by_rank.tolist() == [40_000, 7, *(k for k in range(300) if k != 7)]
    assert found.n_data == len(ids) + 2 * (301 - 256)
    assert found.ids(0, len(ids)).tolist() == ids.tolist() and found.ids(990, 1010).tolist() == ids[990:1010].tolist() and found.ids(3, 3).tolist() == []


def test_files_in_order_with_parts(spark, docs_of, plain):
    """Many files and blocks: every document, and any part of a file, from its place."""
    rows = [(k * 7 % 501, f"Text {k} says it's <|endoftext|> {'word ' * (k % 90)}́é 漢字{k}") for k in range(501)]
    with tokens.cleared(spark):
        folder = tokens.scratch_path(spark, "tokens")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
        try:
            manifest = tokens.write_tokens(docs_of(rows).repartition(5), folder, VOCABULARY, 1, file_tokens=2000)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert manifest.count() > 4
        got = tokens.read_tokens(manifest, batch_tokens=500).orderBy("start").collect()
        assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got] == expected(plain, rows)
        starts = {r.path: r.start for r in tokens.file_starts(manifest).collect()}
        for r in manifest.collect():
            part = tokens.OpenTokens(r.path)
            assert part.doc_ids.tolist() == sorted(part.doc_ids.tolist())
            whole = b"".join(x.ids for x in got if starts[r.path] <= x.start < starts[r.path] + r.n_tokens)
            assert part.ids(5, 900).tobytes() == whole[20:3600]
        tokens.delete_folder(spark, folder)


def test_odd_rows(spark, docs_of, plain):
    """Null ids and texts, repeated rows and ids, texts longer than a piece with and without white space."""
    rows = [(3, "b c"), (3, "b c"), (3, "a"), (None, None), (None, ""), (None, "x y"), (-5, ""), (2**62, " \n "), (9, "some words " * 250_000), (10, "漢" * 800_000 + " x"), (11, "a\n" * 1_200_000)]
    got = sorted((tuple(r) for r in tokens.token_report(docs_of(rows)).collect()), key=lambda r: r[1])
    wanted = expected(plain, rows)
    assert sum(r[2] for r in got) == sum(r[2] for r in wanted)
    assert [r[0] for r in got] == [r[0] for r in wanted]
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in wanted)
    assert tokens.token_report(docs_of([])).collect() == []


def test_hot_id_is_split(spark, docs_of):
    rows = [(7, "the same text, again and again")] * 4000
    with tokens.cleared(spark):
        folder = tokens.scratch_path(spark, "tokens")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            manifest = tokens.write_tokens(docs_of(rows), folder, VOCABULARY, 1)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert max(r.n_docs for r in manifest.collect()) < 2000
        tokens.delete_folder(spark, folder)


def test_query_matches_the_library(spark, plain):
    from quirefold.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in load(spark, "/root/testdata/sf0.01", "documents").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_token_files"](spark, "/root/testdata/sf0.01").collect()) == expected(plain, rows)


def test_words_table_begins_anew(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_BYTES", 20)
    table = tokens.WordTable(VOCABULARY)
    table.clear()
    first = [table.encode(pa.array([f"word{k} other"]))[0].tolist() for k in range(30)]
    assert len(table.words) < 8
    assert first == [tokens.WordTable(VOCABULARY).encode(pa.array([f"word{k} other"]))[0].tolist() for k in range(30)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_vocabulary_gives_the_ids_of_whole_texts(name):
    """One that keeps white space and case is told apart by its probes."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    plain, table = Tokenizer.from_file(path), tokens.WordTable(path)
    assert table.by_words == name.startswith("word")
    texts = ["Some Text, with  Gaps\n\tand Case", "", "x"]
    found = list(tokens.encoded(table, pa.array(texts), 1))
    assert [i for _, ids, _ in found for i in ids.tolist()] == [i for t in texts for i in [*plain.encode(t, add_special_tokens=False).ids, 1]]

import hashlib
import random
from collections import defaultdict

from quirefold.llm import substrings
from quirefold.llm.substrings import substring_dedup
from quirefold.llm.suffix import repeated_windows, suffix_dedup


def brute_words(rows, window=20):
    words = [(d if d is not None else -(2**63), (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (doc, _), (d, w) in zip(rows, words, strict=True):
        cut = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                cut.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in cut)
        out.append((doc, len(w), len(cut), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, size=400):
    raws = [(t or "").encode() for _, t in rows]
    seen = defaultdict(int)
    for r in raws:
        for i in range(len(r) - size + 1):
            seen[r[i : i + size]] += 1
    out = []
    for (doc, _), r in zip(rows, raws, strict=True):
        flag = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                flag[i : i + size] = b"\1" * size
        kept = bytes(b for b, f in zip(r, flag, strict=True) if not f)
        spans = sum(1 for i, f in enumerate(flag) if f and (i == 0 or not flag[i - 1]))
        out.append((doc, len(r), sum(flag), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60, vocabulary=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    pool = [word() for _ in range(vocabulary)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(15, 160))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = [rng.choice(pool) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            p = rng.choice(passages)
            s = rng.randint(0, len(p) // 2)
            w[k:k] = p[s : s + rng.randint(5, len(p))]
        if rng.random() < 0.1:
            w += ["x"] * rng.randint(20, 60)
        rows.append((d, " ".join(w).replace(" ", rng.choice([" ", "\n", " \t"]), 3)))
    for d in range(8):
        text = rng.choice(rows)[1]
        w = text.split()
        if w and d % 2:
            w[rng.randrange(len(w))] = "edited"
            text = " ".join(w)
        rows.append((n + d, text))
    rng.shuffle(rows)
    return rows


EDGES = [(None, None), (None, "x " * 45), (900, None), (901, ""), (902, " \n\t "), (903, "y " * 70), (903, "y " * 70), (904, "y " * 70 + "tail"), (904, "other " + "y " * 70)]


def test_words_match_brute_force(docs_of):
    for seed in (1, 2):
        rows = corpus(seed) + EDGES
        for batches in (1, 5):
            got = sorted((tuple(r) for r in substring_dedup(docs_of(rows), batches=batches).collect()), key=str)
            assert got == brute_words(rows)


def test_index_goes_on_after_reopening(spark, docs_of):
    """Batches added to a reopened and compacted index give what all documents at once give; its joins are merge joins."""
    from quirefold.llm.common import scratch_path
    from quirefold.llm.spans import keyed
    from quirefold.llm.substrings import FingerprintIndex

    rows = sorted((r for r in corpus(9) if r[0] is not None), key=lambda r: r[0])
    parts = [docs_of(rows[k : k + 17]) for k in range(0, len(rows), 17)]
    path, ranges = scratch_path(spark, "test-index"), set()
    for k, part in enumerate(parts):
        if k:
            index = FingerprintIndex.open(spark, path, [keyed(p) for p in parts[:k]])
        else:
            index = FingerprintIndex(spark, path, buckets=3)
        ranges |= {(r["did"], x) for r in index.add(keyed(part)).collect() for x in range(r["lo"], r["lo"] + r["n"] + 19)}
        assert len(index.runs) == 1 + k % 2
        index.save()
    old, new = (spark.table(t) for t in (index.runs[0][0], index._write(spark.table(index.runs[0][0]))[0]))
    with substrings._sorted_scans(spark):
        plan = old.join(new.select("a").hint("merge"), "a", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    removed = defaultdict(int)
    for d, _ in ranges:
        removed[d] += 1
    assert {d: n for d, _, n, _ in brute_words(rows) if n} == dict(removed)


def test_bytes_match_brute_force(docs_of):
    for seed in (3, 4):
        rows = corpus(seed) + EDGES + [(905, "z" * 1500), (906, "q" + "z" * 399), (907, ("ab" * 300) + "c"), (908, "ab" * 250)]
        got = sorted((tuple(r) for r in suffix_dedup(docs_of(rows)).collect()), key=str)
        assert got == brute_bytes(rows)


def test_bytes_with_hot_anchors(docs_of, monkeypatch):
    """Anchors with more contents than a collection holds are split twice; every level gives the same result."""
    from quirefold.llm import suffix

    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = letters(415)
    # one passage in different surroundings, some of which agree for a few bytes: no stretch but the window tells them apart
    around = [(k, letters(30) + rng.choice(("", "tail")) + passage[: rng.randint(396, 415)] + rng.choice("xyz") * rng.randint(0, 5) + letters(30)) for k in range(40)]
    for limit in (2, 6):
        monkeypatch.setattr(suffix, "COLLECTION", limit)
        for rows in (corpus(5), around + EDGES):
            got = sorted((tuple(r) for r in suffix.suffix_dedup(docs_of(rows)).collect()), key=str)
            assert got == brute_bytes(rows)


def test_transforms_are_the_strings_transforms(spark, docs_of):
    from quirefold.llm import suffix
    from quirefold.llm.common import scratch_path
    from quirefold.llm.spans import keyed

    docs = docs_of(corpus(8))
    rows = suffix.transforms(docs, scratch_path(spark, "transforms")).collect()
    strings = suffix.collections(keyed(docs))[1].collect()
    assert rows and {r["collection"] for r in rows} <= {r["a"] for r in strings}
    for name in {r["collection"] for r in rows}:
        columns = sorted((r for r in rows if r["collection"] == name), key=lambda r: -r["col"])
        m, width = columns[0]["strings"], columns[0]["col"] + 1
        grid = [[suffix.PAD] * width for _ in range(m)]
        for r in columns:  # the transform gives the strings back: what precedes each suffix, in the suffixes' order
            if r["col"]:
                for symbol, k in zip(r["symbols"], r["ordered"], strict=True):
                    grid[k][r["col"] - 1] = symbol
        for r in columns:
            if not r["col"]:
                continue
            tails = [tuple(grid[k][r["col"] :]) for k in r["ordered"]]
            if r["col"] < width - 1:
                tails = [t[:-1] for t in tails]  # the last column is never what precedes a suffix
            assert tails == sorted(tails)


def test_empty_tables(docs_of):
    assert substring_dedup(docs_of([])).collect() == []
    assert suffix_dedup(docs_of([])).collect() == []


def test_column_order_is_the_suffix_order():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 12))) for _ in range(30)]
    found = repeated_windows(strings, [0] * 30, [len(s) - 2 for s in strings], 3)
    for k, s in enumerate(strings):
        want = [any(j != k and t[c : c + 3] == s[c : c + 3] for j, t in enumerate(strings)) for c in range(len(s) - 2)]
        assert found[k].tolist() == want


def test_equal_rows_cost_no_more_than_others(spark):
    """5,000 rows that are equal in id and text, with and without an id: linear work, and every row its own verdict."""
    import hashlib
    import time

    from quirefold.llm import substrings, suffix

    text = " ".join(f"w{k * 7919 % 1009}" for k in range(900))
    for doc_id in (4, None):
        rows = [(1, "other words here"), (9, text + " and more")] + [(doc_id, text)] * 5000
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.time()
        cut = suffix.suffix_dedup(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
        assert time.time() - began < 90
        size, nothing = len(text), hashlib.sha256(b"").hexdigest()
        found = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r["count"]) for r in cut}
        assert found == {(doc_id, size, size, 1, nothing, 5000), (9, size + 9, size, 1, hashlib.sha256(b" and more").hexdigest(), 1), (1, 16, 0, 0, hashlib.sha256(b"other words here").hexdigest(), 1)}
        began = time.time()
        kept = substrings.substring_dedup(docs, batches=2).groupBy("doc_id", "n_words", "n_removed").count().collect()
        assert time.time() - began < 90
        # a null id comes before all others; equal places are the same place
        assert {tuple(r) for r in kept} == {(doc_id, 900, 0, 5000), (9, 902, 900, 1), (1, 3, 0, 1)}

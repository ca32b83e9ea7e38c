"""The pipeline's rows against a brute-force version of all five stages."""

import random
from collections import Counter

import corpus_pipeline
from quirefold.llm import quality
from quirefold.llm.decontam import plain

from .test_documents import WORD, brute_classes, brute_secrets, near_corpus, noise, poured

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rejected(text):
    measures = dict(zip(quality.MEASURES, quality.measure(text), strict=True))
    return any(eval(r.fails.replace("AND", "and").replace("OR", "or"), {}, measures) for r in quality.RULES)


def bag(words, n=5):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def contaminated(text, items):
    have = bag(plain(text).split())
    return any(sum(min(c, have[g]) for g, c in want.items()) >= 0.8 * sum(want.values()) for want in items)


def masked(text):
    spans = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in brute_secrets(text)[4].split(",") if x))
    out, at = "", 0
    for s, e in spans:
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_run_matches_brute_force(spark, tmp_path):
    rng = random.Random(11)
    benchmark = [(k, noise(rng, rng.randint(15, 50))) for k in range(8)]
    texts = [(d, t) for d, t in near_corpus(rng) if len(t.split()) >= 12]
    texts += [(2000 + k, noise(rng, 60) + " " + benchmark[k][1] + " " + noise(rng, 40)) for k in range(8)]
    texts += [(3000 + k, noise(rng, 30) + ' token = "' + "%032x" % rng.getrandbits(128) + '" ' + noise(rng, 20)) for k in range(10)]
    texts += [(4000, None), (4001, ""), (4002, "few words"), (4003, "### " * 40), (4004, "same line here\n" * 30), (2001, texts[0][1])]
    rng.shuffle(texts)
    rows = [(d, t, "en", rng.choice(["a", "b", "ü", None]), len(t or "")) for d, t in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [r for r in rows if not rejected(r[1])]
    classes = dict(brute_classes([(r[0], r[1]) for r in left]))
    left = [r for r in left if classes[r[0]] == r[0]]
    items = [bag(plain(t).split()) for _, t in benchmark]
    bad = {r[0] for r in left if contaminated(r[1], items)}
    assert bad
    left = [(r[0], masked(r[1]), r[3]) for r in left if r[0] not in bad]
    assert any("[SECRET]" in t for _, t, _ in left)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
    assert sorted((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in docs.fillna({"source": "~"}).collect()) == sorted((d, t, s or "~", len(t)) for d, t, s in left)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = Counter()
    for _, t, s in left:
        sizes[s] += len(WORD.findall(t))
    targets = poured(sizes)
    assert sorted((r["doc_id"], r["size"], r["source_size"]) for r in got) == sorted((d, len(WORD.findall(t)), sizes[s]) for d, t, s in left)
    assert all(abs(r["target"] - targets[r["source"]]) < 1e-6 * targets[r["source"]] + 1e-6 and r["taken"] <= 3 * r["size"] for r in got)


def test_odd_tables(spark, tmp_path):
    """Null and repeated ids, null texts, repeated rows and clashing columns; and a table without rows."""
    rng = random.Random(12)
    wide = SCHEMA + ", row string, did long, th long, uid string, spans string, failed long, n_words long, __ledger int"
    text = [noise(rng, 80) for _ in range(4)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (1, text[2]), (1, text[3]), (2, None), (3, ""), (None, None), (4, text[3] + " more")]
    full = [(d, t, "en", "s", len(t or ""), "r", 1, 2, "u", "x", 3, 4, 5) for d, t in rows]
    for name, some in (("full", full), ("empty", [])):
        spark.createDataFrame(some, wide).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, noise(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == [c.split()[0] for c in wide.split(", ")], step
        kept = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        assert kept == ([] if not some else sorted([(None, text[0]), (None, text[1]), (1, text[2]), (1, text[3])], key=str))
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == len(kept)

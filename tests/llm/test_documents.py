"""Quality, licenses, secrets, mixing, decontamination and near duplicates against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

from quirefold.llm import decontam, licenses, mixing, omh, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None), (1, ""), (2, " \n\t"), (3, "a b c"), (3, "a b c"), (4, "word " * 3000), (5, "é ß \x0b x y")]


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 5))
    lines, dup, earlier = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_measures(docs_of):
    rng = random.Random(1)
    rows = ODD + [(10 + k, " ".join(rng.choice(["a", "b", "c#", "d|", "E\n", "\n\n"]) for _ in range(rng.randint(0, 80)))) for k in range(60)]
    got = quality.quality_report(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = sorted(((d, *brute_quality(t)) for d, t in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_report(docs_of([])).collect() == []


def test_quality_policies_and_ablations(docs_of):
    rng = random.Random(2)
    rows = ODD + [(10 + k, " ".join(rng.choice(["alpha", "beta", "###", "GAMMA", "12345", "d"]) for _ in range(rng.randint(0, 40)))) for k in range(80)]
    entries = quality.ledger(docs_of(rows)).cache()
    failed = [r["failed"] for r in entries.collect()]
    table = {r["rule"]: r for r in quality.ablations(entries, quality.STANDARD).collect()}
    for rule in quality.RULES:
        rest = quality.STANDARD.mask & ~(1 << rule.bit)
        assert table[rule.name]["n_failed"] == sum(f >> rule.bit & 1 for f in failed)
        assert table[rule.name]["n_kept_without"] == sum(f & rest == 0 for f in failed)
        assert table[rule.name]["n_only"] == sum((f >> rule.bit & 1) and f & rest == 0 for f in failed)
    kept = quality.keep_good(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert kept.count() == quality.apply_policy(entries, quality.STANDARD).filter("kept").count()


def brute_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(docs_of):
    rows = ODD + [
        (10, "Under the MIT License; see Apache, LICENSE. General-Public\nLicense! GENERAL public license"),
        (11, "GNU Lesser General Public License v2.1 or later"),
        (12, "mit licenses, mitlicense, mit—license, mit License"),
        (13, "CC BY-NC 4.0 and SPDX-License-Identifier: GPL-2.0-only"),
        (14, "license " * 500 + "mit license"),
    ]
    got = licenses.license_scan(docs_of(rows)).collect()
    want = sorted(((d, *brute_license(t)) for d, t in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    by = {r["doc_id"]: r for r in got}
    assert by[11]["labels"] == "gpl,lgpl-2.1"  # the base label stays, the contained GPL detections don't add one
    assert by[13]["labels"] == "cc-by-nc-4.0,gpl-2.0"
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert licenses.license_scan(docs_of([])).collect() == []


def test_license_rules_find_samples_of_themselves():
    """For each rule: texts made from its regex are found by it, hold its keywords, and wrapped ones are found too."""
    import re
    import warnings

    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    rules, by_keyword = licenses.compiled()
    assert len(rules) > 300 and len({r.pattern for r, _ in rules}) == len(rules)
    for k, (rule, pattern) in enumerate(rules):
        bare = re.compile(pattern.pattern.removeprefix(r"(?<![^\W_])").removesuffix(r"(?!\.?\d)(?![^\W_])"), re.S | re.A)

        def holds(sample, k, pattern, rule):
            sample = sample.lower()
            for text in (sample, re.sub(r"\s[\s*/#]*", "\n * ", sample)):
                if not pattern.fullmatch(text):
                    continue
                called = {i for word, found in by_keyword.items() if word in text for i, rest in found if all(x in text for x in rest)}
                assert k in called, (rule, text)
                spans = licenses.detect(f"x. {text} . y", rules, by_keyword)
                assert any(s <= 3 and e >= 3 + len(text) and priority >= rule.priority for s, e, _, priority in spans), (rule, text, spans)

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tried = settings(max_examples=6, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
            tried(given(st.from_regex(bare, fullmatch=True), st.just(k), st.just(pattern), st.just(rule))(holds))()


def test_license_labels_match_brute_force():
    """All rules on all texts without the prefilter; suppression by looking at all pairs."""
    rng = random.Random(31)
    rules, by_keyword = licenses.compiled()
    parts = ["gnu lesser general public license v2.1 or later", "gnu general\n# public license version 3", "mit license", "(c) 2020", "all rights reserved", "apache license, version 2.0", "cc by-nc 4.0", "creative commons attribution-sharealike 3.0", "bsd-3-clause license", "gpl", "agplv3+", "released to the public domain", "spdx-license-identifier: mit", "license", "mozilla public licence 2.0", "some words", "isc license,"]
    for _ in range(150):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        found = [(-rule.priority, k, m.start(), m.end(), rule.label) for k, (rule, pattern) in enumerate(rules) for m in pattern.finditer(text)]
        kept = []
        for _, _, s, e, label in sorted(found, key=lambda f: f[:3]):
            if not any(a <= s and e <= b for a, b, _ in kept):
                kept.append((s, e, label))
        assert sorted(kept) == sorted(d[:3] for d in licenses.detect(text, rules, by_keyword))


def brute_secrets(text):
    text, found = text or "", []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("[0-9a-f]{32,}", "[0-9a-f]+")
        for m in re.finditer(pattern, text, re.A):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), k, m.end()))
    show = lambda xs: ",".join(f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in sorted(xs))
    base = [x for x in found if x[1] < 3]
    return tuple(sum(x[1] == k for x in base) for k in range(3)) + (hashlib.sha256(show(base).encode()).hexdigest(), show(found))


def test_secrets(docs_of):
    rng = random.Random(3)
    parts = ["token", "secret=token", ": abcdefgh12", "PassWord = 'abc", "é🙂", "AKIA", "AKIAABCDEFGHIJKLMN", "api_key:", "apikey=\"", "0123456789abcdef" * 2, "deadbeef", " ", "\n", "=", "x" * 9, "ghp_" + "A1" * 20, "://me:pass@", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIiOi.abcdef", "xoxb-1234567890"]
    rows = ODD + [(10 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(150)]
    frame = secrets.secret_report(docs_of(rows))
    got = sorted((tuple(r) for r in frame.collect()), key=str)
    assert got == sorted(((d, *brute_secrets(t)) for d, t in rows), key=str)
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert secrets.secret_report(docs_of([])).collect() == []


def test_masking(docs_of):
    rows = [(1, "a token = abcdefgh12345678 b"), (2, None), (3, "clean"), (4, "deadbeef" * 5 + " token=" + "0123456789abcdef" * 3), (4, "deadbeef" * 5 + " token=" + "0123456789abcdef" * 3)]
    out = secrets.without_secrets(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.fillna({"text": ""}).collect())
    assert got == [(1, "a [SECRET] b", 12), (2, "", 0), (3, "clean", 5), (4, "[SECRET] [SECRET]", 17), (4, "[SECRET] [SECRET]", 17)]


def test_trigram_queries_hold_for_every_match():
    grams = lambda q: {frozenset(x) for x in q}
    assert grams(secrets.trigram_query("AKIA[A-Z0-9]+")) == {frozenset(("aki", "kia"))}
    assert secrets.trigram_query("[0-9a-f]{32,}") == secrets.ANYTHING
    assert grams(secrets.trigram_query("(abc|xyz)d?")) >= {frozenset(("abc",)), frozenset(("xyz",))} or secrets.trigram_query("(abc|xyz)d?")
    for clause in secrets.trigram_query("ab[cd]e"):
        assert any(all(t in w for t in clause) for w in ("abce", "abde"))


def poured(sizes):
    """Targets of sources in their order: one level for all, found by bisection; weights 1, 2, 3; at most 3 times the size."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    at = lambda level: {s: min(3 * sizes[s], level * (1 + k % 3)) for k, s in enumerate(names)}
    low, high = 0.0, 3.0 * total + 1
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle).values()) < total else (low, middle)
    return at(high)


def mixing_rows(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = rng.choice([None, "a", "b", "b", "b", "ü", "zz"])
        rows.append((k if k % 50 else None, rng.choice([None, "", "w " * rng.randint(1, 400)]) if k % 9 == 0 else "w " * int(math.exp(rng.uniform(0, 6))), source))
    return rows


def test_mixing(docs_of):
    rows = mixing_rows(4)
    frame = docs_of(rows)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = poured(sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]] + 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 3 * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 10), s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame).collect()))
    assert mixing.mix(docs_of([])).collect() == []


def test_mixing_keeps_languages_and_lengths(spark):
    """Sources differ in languages; mixing them anew keeps the corpus's shares, which target / size alone wouldn't."""
    rng = random.Random(14)
    rows = [(k, "w " * rng.randint(5, 300), rng.choice("xxxyyz" if k % 3 else "xyyyyzz"), "a" if k % 3 else "b") for k in range(3000)]
    rows += [(9000, None, None, "a"), (9001, "w w", None, None), (9002, "w w", "x", None), (9002, "w w", "x", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    lang = {r[0]: r[2] for r in rows}
    before, after, plain = Counter(), Counter(), Counter()
    for r in got:
        before[lang[r["doc_id"]]] += r["size"]
        after[lang[r["doc_id"]]] += r["taken"]
        plain[lang[r["doc_id"]]] += r["size"] * r["target"] / r["source_size"]
    assert len({r["rate"] for r in got if r["source"] == "a"}) > 5  # documents of one source are tilted
    total, mixed = sum(before.values()), sum(after.values())
    off = lambda c, t: sum(abs(c[x] / t - before[x] / total) for x in "xyz")
    assert off(after, mixed) < 0.1 * off(plain, sum(plain.values()))


def test_duals_are_those_of_raking(spark):
    """Without a penalty and a bound that matters, the optimum is what iterative proportional fitting finds."""
    import numpy as np

    rng = np.random.default_rng(3)
    mass = rng.uniform(50, 100, (3, 4, 5))
    hidden = np.exp(rng.normal(0, 0.2, 3)[:, None, None] + rng.normal(0, 0.2, 4)[:, None] + rng.normal(0, 0.2, 5)) * mass
    targets, shares = hidden.sum((1, 2)), np.concatenate([hidden.sum((0, 2)), hidden.sum((0, 1))])
    fitted = mass.copy()
    for _ in range(500):
        fitted *= (targets / fitted.sum((1, 2)))[:, None, None]
        fitted *= (shares[:4] / fitted.sum((0, 2)))[:, None]
        fitted *= shares[4:] / fitted.sum((0, 1))
    cells = [(s, a, 4 + b, float(mass[s, a, b])) for s in range(3) for a in range(4) for b in range(5)]
    duals = mixing.newton_duals(spark.createDataFrame(cells, "skey long, lgroup long, bgroup long, tokens double").repartition(3), targets, shares, max_rate=50.0, ridge=1e-9)
    rates = duals.rates(*(np.array([c[k] for c in cells]) for k in range(3)))
    assert np.allclose(rates * mass.ravel(), fitted.ravel(), rtol=1e-5)


def test_shares_stop_at_three_times_the_size():
    got = mixing.capped_shares([10, 1000, 100, 0], [1, 2, 3, 1])
    assert got[0] == 30 and got[2] == 300 and got[3] == 0 and abs(sum(got) - 1110) < 1e-9


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_decontamination(spark, docs_of):
    rng = random.Random(5)
    items = [(k, noise(rng, rng.randint(12, 60))) for k in range(40)] + [(None, "tiny item"), (90, None), (91, "")]
    rows, planted = [*ODD], set()
    for k in range(80):
        item = items[k % 40]
        words = item[1].split()
        body = noise(rng, rng.randint(0, 300)).split()
        at = rng.randint(0, len(body))
        if k % 2:
            if k % 4 == 1 and len(words) > 30:
                words[len(words) // 2] = "changed"
            text = " ".join(body[:at] + ["(" + words[0].upper() + ",", *words[1:-1], words[-1] + "%%%"] + body[at:])
            planted.add((100 + k, item[0]))
        else:
            text = " ".join(body)
        rows.append((100 + k, text))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs_of(rows), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted
    assert all(0.8 <= r["similarity"] <= 1 for r in got)
    kept = decontam.clean_only(docs_of(rows), table)
    assert kept.columns == docs_of(rows).columns and kept.count() == len(rows) - len({d for d, _ in planted})
    assert decontam.contaminated(docs_of([]), table).collect() == []
    assert decontam.contaminated(docs_of(rows), table.filter("false")).collect() == []


def test_hamming_blocks_find_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(6)
    items = rng.integers(0, 2**64, 50, dtype=np.uint64)
    prints = np.concatenate([items ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(0, 24)])
    index = decontam.ItemIndex(list(range(50)), items)
    got = set(zip(*(x.tolist() for x in index.near(prints)), strict=True))
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(items) if int(p ^ q).bit_count() <= decontam.RADIUS}
    assert got == want


def distance(a, b):
    """Edit distance of two word sequences, cell by cell."""
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def brute_linked(a, b):
    """Whether two word sequences are near duplicates: edit distance of a fifth, or four fifths of all five-word shingles."""
    if min(len(a), len(b)) < 5:
        return False
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    longest = max(len(a), len(b))
    apart = 10 * (longest - sum((Counter(a) & Counter(b)).values())) > 2 * longest  # no alignment can keep enough
    return len(x & y) >= 0.8 * len(x | y) or (not apart and 10 * distance(a, b) <= 2 * longest)


def brute_classes(rows):
    """Classes of equal and of linked word sequences."""
    words = [WORD.findall(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and (rows[i][0] == rows[j][0] or words[i] == words[j] or brute_linked(words[i], words[j])):
                parent[find(i)] = find(j)
    key = lambda d: -math.inf if d is None else d
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d, key=key)
    return sorted(((d, least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_corpus(rng):
    rows = []
    for _ in range(12):
        base = noise(rng, rng.randint(40, 220)).split()
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                at = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[at] = "edit" + str(rng.randint(0, 99))
                else:
                    del w[at]
            rows.append((1000 + len(rows), rng.choice([" ", "\n"]).join(w)))
    return rows


def test_near_duplicates(docs_of, monkeypatch):
    rows = ODD + near_corpus(random.Random(7))
    want = brute_classes(rows)
    got = omh.near_duplicates(docs_of(rows)).select("doc_id", "class_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    monkeypatch.setattr(omh, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(omh, "BLOCK_ROWS", 3)
    got = omh.near_duplicates(docs_of(rows)).select("doc_id", "class_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    kept = omh.one_of_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in want}
    assert omh.near_duplicates(docs_of([])).collect() == []


def test_alignment_keeps_a_common_subsequence():
    """Never more than the longest one, and all of it but for pieces shorter than a run."""
    rng = random.Random(17)
    for _ in range(300):
        a = [rng.choice("abcdefghij") + rng.choice("klm") for _ in range(rng.randint(5, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(b) or 1)
            b[at : at + rng.randint(0, 1)] = rng.choice([[], ["new"], ["x", "y"]])
        if len(b) < 5:
            continue
        kept = omh.kept_words(omh.Text(" ".join(a)), omh.Text(" ".join(b)))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert kept <= table[-1][-1]
        if a == b:
            assert kept == len(a)
    text = [f"w{k}" for k in range(200)]
    other = [w if k % 10 else "new" for k, w in enumerate(text)]
    assert omh.kept_words(omh.Text(" ".join(text)), omh.Text(" ".join(other))) == 180
    assert omh.kept_words(omh.Text(" ".join(text)), omh.Text(" ".join(text[100:] + text[:100]))) == 0  # outside the band
    assert omh.linked(omh.Text(" ".join(text)), omh.Text(" ".join(text[100:] + text[:100])))


def test_links_that_the_leader_does_not_show(spark):
    """A chain of edits and a sharing of parts: texts far from their leader are linked to others of its cluster."""
    rng = random.Random(18)
    rows = []
    for k in range(6):
        base, words = noise(rng, 200).split(), []
        for step in range(9):  # each differs from the one before by a tenth, from the first by ever more
            words.append(" ".join(base[: 200 - 20 * step] + noise(rng, 20 * step).split()) if step else " ".join(base))
            base = words[-1].split()
        rows += [(k, 100 * k + step, text) for step, text in enumerate(words)]
    members = [(100 * c, uid, text) for c, uid, text in rows]
    words = {uid: text.split() for _, uid, text in rows}
    for limit in (8192, 2):
        omh_rows, omh.BLOCK_ROWS = omh.BLOCK_ROWS, limit
        try:
            links = {tuple(sorted((r["u"], r["v"]))) for r in omh.link_members(spark.createDataFrame(members, "cluster long, uid long, text string"), 4).collect()}
        finally:
            omh.BLOCK_ROWS = omh_rows
        assert all(brute_linked(words[u], words[v]) for u, v in links)
        root = {u: u for u in words}
        for _ in words:
            for u, v in links:
                root[u] = root[v] = min(root[u], root[v])
        meets = lambda u, v: any(x == y for x, y in zip(*(omh.sketches(omh.text_shingles(" ".join(words[w]))[1]) for w in (u, v)), strict=True))
        for u in words:
            for v in words:
                if u < v and u // 100 == v // 100 and meets(u, v) and brute_linked(words[u], words[v]):
                    assert root[u] == root[v], (u, v, limit)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r["u"]: r["root"] for r in omh.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}

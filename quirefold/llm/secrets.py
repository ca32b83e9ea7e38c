r"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regex is analysed on the driver into a Boolean query over trigrams of lowered text: an OR of ANDs that any
match implies. The index holds postings (trigram, document) for the trigrams that the rules ask for; intersecting the
postings of each AND gives candidate documents, and only those are verified by the regex itself. A rule without
mandatory trigrams (runs of hex digits) is verified on every document.

Positions come from splitting a text at the matches: what lies between matches and the matches themselves add up to
code-point offsets.

Null text: empty. Empty text: no spans, the digest of the empty string. Null ids: allowed. Repeated rows: a row each.
Empty table: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key

SPAN = "array<struct<start: int, kind: int, stop: int>>"


@dataclass(frozen=True)
class SecretRule:
    """Matches of pattern whose given group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    plain: str = ""  # the same without possessive loops and look-ahead, for engines of linear time that have neither


# The base rules of the contract, in their order, then the method's own.
BASE_RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    SecretRule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A private key from its header to its END line, whatever stands between but other lines of five dashes; without an END
#: line, the header, PEM headers and the base64 run that follow. Loops are possessive, so keys of any length are matched.
KEY_NAME = r"[A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
KEY_GAP = r"""(?:\\[nrt]|[\x20\t\r\n"'+,>#*|/\\])*+"""
KEY_HEADER = r"(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID):[^\n\\]*+"
PRIVATE_KEY = (
    rf"-----BEGIN {KEY_NAME}"
    rf"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END {KEY_NAME}"
    rf"|(?:{KEY_GAP}{KEY_HEADER})*+(?:{KEY_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{KEY_GAP}[A-Za-z0-9+/]++={{0,2}})?+"
    r"|)"
)
#: Gaps take "+", "/" and escapes first, so what follows them begins with a letter or digit.
_RUN = r"[A-Za-z0-9][A-Za-z0-9+/]"
PLAIN_GAP, PLAIN_HEADER = KEY_GAP.replace("*+", "*"), KEY_HEADER.replace("*+", "*")
PLAIN_PRIVATE_KEY = (
    rf"-----BEGIN {KEY_NAME}"
    rf"(?:(?:[^-]|-{{1,4}}[^-])*-----END {KEY_NAME}"
    rf"|(?:{PLAIN_GAP}{PLAIN_HEADER})*(?:{PLAIN_GAP}{_RUN}{{15,}}={{0,2}})+(?:{PLAIN_GAP}{_RUN}*={{0,2}})?"
    r"|)"
)
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    SecretRule("npm", r"npm_[A-Za-z0-9]{36}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    SecretRule("private_key", PRIVATE_KEY, plain=PLAIN_PRIVATE_KEY),
    SecretRule("url_password", r"://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES

Query = frozenset  # of frozensets of trigrams: an OR of ANDs
ANYTHING: Query = frozenset([frozenset()])
_WIDE = 32


def _both(a: Query, b: Query) -> Query:
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= _WIDE else min(a, b, key=len)


def _grams(words: set[str]) -> Query:
    """What holds if one of the words occurs."""
    found = frozenset(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words)
    return ANYTHING if frozenset() in found else found


def _analyse(sequence) -> tuple[set[str] | None, Query]:
    """All strings that the sequence matches, if few; and the query that any match implies."""
    words: set[str] = {""}
    query, exact = ANYTHING, True
    for op, value in sequence:
        name, options, implied = str(op), None, ANYTHING
        if name == "LITERAL":
            options = {chr(value).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 6:
            options = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            options, implied = _analyse(value[3])
        elif name == "BRANCH":
            parts = [_analyse(branch) for branch in value[1]]
            options = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            implied = frozenset().union(*(p[1] for p in parts))
            implied = ANYTHING if frozenset() in implied else implied
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            inside, below = _analyse(inner)
            if (low, int(high)) == (0, 1) and inside is not None:
                options = inside | {""}
            elif low == int(high) and low <= 8 and inside is not None and len(inside) == 1:
                options = {next(iter(inside)) * low}
            elif low:
                implied = below
        elif name == "AT":
            continue
        if options is not None and len(words) * len(options) <= _WIDE:
            words = {w + o for w in words for o in options}
        else:
            query = _both(_both(query, _grams(words)), implied if options is None else _grams(options))
            words, exact = {""}, False
    query = _both(query, _grams(words))
    return (words, query) if exact else (None, query)


def trigram_query(pattern: str) -> Query:
    """The OR of ANDs of trigrams that a text with a match holds, once lowered."""
    found = _analyse(parser.parse(pattern))[1]
    return frozenset(x for x in found if not any(y < x for y in found))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """row (all columns of docs in one struct, so that no name clashes), did, th."""
    return docs.select(F.struct("*").alias("row"), *row_key())


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for these trigrams: trigram number, did, th; a row for each document that holds it."""
    lowered = texts.select("did", "th", F.lower(F.coalesce("row.text", F.lit(""))).alias("lowered"))
    held = F.array_compact(F.array(*(F.when(F.contains("lowered", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams))))
    return lowered.select("did", "th", F.explode(held).alias("trigram"))


def candidates(texts: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """did, th, rules: bit r is set if the postings of one AND of rule r all hold the document."""
    clauses = [(r, clause) for r, rule in enumerate(rules) for clause in trigram_query(rule.pattern) if clause]
    trigrams = sorted({t for _, clause in clauses for t in clause})
    number = {t: k for k, t in enumerate(trigrams)}
    rows = [(number[t], c, len(clause), 1 << r) for c, (r, clause) in enumerate(clauses) for t in clause]
    table = texts.sparkSession.createDataFrame(rows, "trigram int, clause int, needed int, rule long")
    met = postings(texts, trigrams).distinct().join(F.broadcast(table), "trigram")  # the table has a row for each trigram of a rule
    full = met.groupBy("did", "th", "clause", "rule", "needed").count().filter("count = needed")
    return full.groupBy("did", "th").agg(F.bit_or("rule").alias("rules"))


def rule_spans(text: Column, rule: SecretRule, number: int) -> Column:
    """Leftmost non-overlapping matches as start, kind, stop; short ones are dropped after they took their place."""
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    sizes = F.zip_with(F.transform(whole, F.length), F.transform(counted, F.length), lambda w, c: F.struct(w.alias("w"), c.alias("c")))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), sizes, lambda b, s: F.struct(F.length(b).alias("gap"), s["w"].alias("w"), s["c"].alias("c")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), (begin + x["w"]).alias("stop"))
        spans = F.when(x["c"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((begin + x["w"]).alias("at"), spans.cast(SPAN).alias("spans"))

    return F.aggregate(steps, start, step, lambda state: state["spans"])


def described(spans: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_spans(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """row (the columns of docs) and spans, sorted by start, then kind."""
    texts = keyed_texts(docs)
    joined = texts.join(candidates(texts, rules), ["did", "th"], "left").withColumn("text", F.coalesce("row.text", F.lit("")))
    none = F.array().cast(SPAN)
    found = []
    for k, rule in enumerate(rules):
        spans = rule_spans(F.col("text"), rule, k)
        mandatory = trigram_query(rule.pattern) != ANYTHING
        wanted = F.col("rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0 if mandatory else F.col("text").rlike(rule.pattern)
        found.append(F.when(F.coalesce(wanted, F.lit(False)), spans).otherwise(none))
    return joined.select("row", F.array_sort(F.concat(*found)).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    found = secret_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    kinds = len(BASE_RULES)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = described(F.filter("spans", lambda x: x["kind"] < kinds))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), described(F.col("spans")).alias("spans"))


MASK = "[SECRET]"


def redacted(text: Column, spans: Column) -> Column:
    """text with each maximal run of spans replaced by MASK."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, x: Column) -> Column:
        begin = x["start"]
        apart = F.concat(state["parts"], F.array(F.substring(text, state["at"] + 1, F.greatest(F.lit(0), begin - state["at"])), F.lit(MASK)))
        parts = F.when((begin >= state["at"]) & ((begin > 0) | (F.size(state["parts"]) == 0)), apart).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], x["stop"]).alias("at"), parts.alias("parts"))

    done = F.aggregate(spans, start, step)
    return F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs in their own columns, secrets masked and n_chars following; texts without any stay as they are (null too)."""
    found = secret_spans(docs)
    any_found = F.size("spans") > 0
    text = F.when(any_found, redacted(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(any_found, F.length(text).cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*(changed[c].alias(c) if changed.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns))

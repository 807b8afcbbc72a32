"""Secret scans through a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of ANDs of trigrams that any match must
hold, in lower case. Texts are posted under the trigrams that some rule asks for; postings are intersected per AND, and only the texts that come
out are read with that rule's expression. A rule without mandatory trigrams reads every text.

Texts stand in the index by a 64-bit hash. Copies of a text are posted once, and two texts of one hash only
become candidates for each other's rules, which the expression then settles.

Defined results. Null text is empty: no spans. Repeated rows are answered each on its own; an id may be null. No rows: no rows.
Positions count code points. Other columns are kept by `scan` and `mask`; a column named like a working column (`__secret_...`) is not allowed.
"""
from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """kind; regular expression; and, where `least` is set, the length its group must have, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")

# Kinds in the order in which spans that start together are listed. Runs of one class of characters are taken whole, so a length
# asked for inside the expression drops the same matches as one asked for afterwards; only the value of `assign` differs.
RULES = [
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
]
BASE = ("assign", "access", "hex")
#: Salts of the candidates, so that rows of one text do not meet in one task.
SALTS = 8
#: More ANDs than this make a query not worth asking; the rule then reads every text.
MOST_WAYS = 256

SPAN = "struct<start:int,kind_no:int,end:int,kind:string>"


# Boolean trigram queries


def ways(nodes, most: int = MOST_WAYS) -> list[list[str]] | None:
    """The ways a parsed expression can match, each as runs of fixed lower-case text with anything between; None for too many."""
    out = [[""]]
    for what, value in nodes:
        if what is op.LITERAL:
            more = [[chr(value).lower()]]
        elif what is op.IN and all(k is op.LITERAL for k, _ in value) and len({chr(v).lower() for _, v in value}) <= 5:
            more = [[c] for c in sorted({chr(v).lower() for _, v in value})]
        elif what is op.SUBPATTERN:
            more = ways(value[-1], most)
        elif what is op.BRANCH:
            more = [ways(branch, most) for branch in value[1]]
            more = None if None in more else list(itertools.chain(*more))
        elif what in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] <= 1:
            more = ways(value[2], most)
            more = None if more is None else [*([[""]] if value[0] == 0 else []), *more]
        elif what in (op.AT, op.ASSERT, op.ASSERT_NOT):
            more = [[""]]
        elif what in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
            # the first time, then anything
            once = ways(value[2], most)
            more = None if once is None else [[*w, ""] for w in once]
        else:
            more = [["", ""]]
        if more is None or len(out) * len(more) > most:
            return None
        out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in out for b in more]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of trigrams, or None if some way to match has no mandatory trigram."""
    found = ways(_parser.parse(pattern))
    if found is None:
        return None
    ands = {frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2)) for way in found}
    return None if frozenset() in ands else sorted((a for a in ands if not any(b < a for b in ands)), key=sorted)


# the index


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def postings(docs: DataFrame, text_col: str, grams: list[str]) -> DataFrame:
    """(gram, text): which texts hold which of the trigrams."""
    low = F.lower(F.col(text_col))
    held = F.array_compact(F.array(*[F.when(low.contains(g), F.lit(g)) for g in grams]))
    return docs.select(text_hash(text_col).alias("text"), F.explode(held).alias("gram")).distinct()


def candidates(docs: DataFrame, text_col: str, rules: list[Rule]) -> DataFrame:
    """(text, rules): for texts that may match, the kinds whose queries they satisfy."""
    asked = [(r.kind, f"{r.kind}/{i}", g, len(a)) for r in rules for i, a in enumerate(trigram_query(r.pattern) or ()) for g in sorted(a)]
    spark = docs.sparkSession
    if not asked:
        return spark.createDataFrame([], "text bigint, rules array<string>")
    posted = postings(docs, text_col, sorted({g for _, _, g, _ in asked}))
    terms = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("and"), F.lit(g).alias("gram"), F.lit(n).alias("need")) for k, a, g, n in asked])
    terms = spark.range(1).select(F.explode(terms).alias("t")).select("t.*")
    met = posted.join(F.broadcast(terms), "gram").groupBy("text", "kind", "and", "need").agg(F.count("*").alias("held")).filter("held = need")
    return met.groupBy("text").agg(F.collect_set("kind").alias("rules"))


# verification


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Matches of the rule, leftmost first, as an array of SPAN: the pieces between matches and the matches give the positions."""
    matches, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    sizes = F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), F.lit(True).alias("holds")))
    if rule.least:
        values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        sizes = F.zip_with(sizes, values, lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), (F.length(v) >= rule.least).alias("holds")))
    sizes = F.filter(sizes, lambda s: s["size"].isNotNull())
    nothing = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))

    def step(state, s):
        begin = state["at"] + s["gap"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind_no"), (begin + s["size"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((begin + s["size"]).alias("at"), F.concat(state["spans"], F.when(s["holds"], F.array(span)).otherwise(nothing)).alias("spans"))

    return F.aggregate(sizes, start, step, lambda state: state["spans"])


def scan(docs: DataFrame, *, text_col: str = "text", rules: list[Rule] | None = None, spans_col: str = "spans") -> DataFrame:
    """The rows, all columns, and an array of SPAN per rule, `__secret_<kind>`, joined and sorted in spans_col."""
    rules = RULES if rules is None else rules
    salt = F.explode(F.array(*map(F.lit, range(SALTS))))
    # under another name before the join, so that no column of the documents can clash
    found = candidates(docs, text_col, rules).select(F.col("text").alias("__secret_text"), F.col("rules").alias("__secret_rules"), salt.alias("__secret_salt"))
    # any salt will do, as each has all candidates; a table of texts alone has only the place of a row to tell copies apart
    told = [F.col(f"`{c}`") for c, kind in docs.dtypes if kind in ("bigint", "int", "string") and c != text_col]
    spread = F.pmod(F.xxhash64(*told) if told else F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = docs.withColumn("__secret_text", text_hash(text_col)).withColumn("__secret_salt", spread).join(found, ["__secret_text", "__secret_salt"], "left")
    text, nothing = F.coalesce(F.col(text_col), F.lit("")), F.array().cast(f"array<{SPAN}>")
    for number, rule in enumerate(rules):
        asked = F.lit(True) if trigram_query(rule.pattern) is None else F.coalesce(F.array_contains("__secret_rules", rule.kind), F.lit(False))
        rows = rows.withColumn(f"__secret_{rule.kind}", F.when(asked & text.rlike(rule.pattern), spans_of(text, rule, number)).otherwise(nothing))
    rows = rows.withColumn(spans_col, F.array_sort(F.concat(*[F.col(f"__secret_{r.kind}") for r in rules])))
    return rows.drop("__secret_text", "__secret_salt", "__secret_rules")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan(docs.select(id_col, text_col), text_col=text_col)
    count = lambda kind: F.size(f"__secret_{kind}").cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(id_col, *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents, all columns, with every span replaced by the mark; spans that overlap or touch become one."""
    found = scan(docs, text_col=text_col, spans_col="__secret_spans")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        begin, upto = F.greatest(s["start"], state["at"]), F.greatest(s["end"], state["at"])
        apart = (s["start"] > state["at"]) | (state["out"] == "")
        kept = F.when(s["start"] > state["at"], text.substr(state["at"] + 1, begin - state["at"])).otherwise("")
        return F.struct(upto.alias("at"), F.concat(state["out"], kept, F.when(apart, F.lit(mark)).otherwise("")).alias("out"))

    masked = F.aggregate("__secret_spans", start, step, lambda state: F.concat(state["out"], text.substr(state["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("__secret_spans") > 0, masked).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


# the same in DuckDB


def oracle_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    lists = []
    for number, rule in enumerate(RULES):
        p = quoted(rule.pattern)
        values = f"regexp_extract_all(text, {p}, {rule.group})"
        keep = f"length(v[i]) >= {rule.least}"
        lists.append(f"""
  SELECT doc_id, {number} AS k, list_filter(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN {keep} THEN struct_pack(s := ends[i] - length(m[i]), k := {number}, e := ends[i], n := {quoted(rule.kind)}) END), lambda x: x IS NOT NULL) AS spans
  FROM (SELECT doc_id, m, v, list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(b[:i], lambda x: length(x))) + list_sum(list_transform(m[:i], lambda x: length(x))) AS BIGINT)) AS ends
    FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS m, {values} AS v, regexp_split_to_array(text, {p}) AS b FROM t WHERE regexp_matches(text, {p})))""")
    every = " UNION ALL ".join(lists)
    joined = "list_aggregate(list_transform({0}, lambda x: x.n || ':' || x.s || ':' || x.e), 'string_agg', ',')"
    count = lambda k: f"CAST(coalesce(len(list_filter(spans, lambda x: x.k = {k})), 0) AS BIGINT)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({every}),
g AS (SELECT doc_id, list_sort(flatten(list(spans))) AS spans FROM f GROUP BY doc_id)
SELECT t.doc_id, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex,
  sha256(coalesce({joined.format("list_filter(spans, lambda x: x.k < 3)")}, '')) AS base_sha256, coalesce({joined.format("spans")}, '') AS spans
FROM t LEFT JOIN g USING (doc_id)"""

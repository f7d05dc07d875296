"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is parsed, and a Boolean query over lower-case trigrams is derived
that every match satisfies: an OR of ANDs. Texts are indexed by the trigrams that occur in some
rule's query (trigram -> document postings); a rule's postings are intersected by counting, and
only candidate documents are verified with the expression itself. A rule without mandatory
trigrams scans all texts. The index only rules documents out, so results are those of a full scan.

Defined cases: null text is empty; repeated rows give equal rows, and null or shared doc_id only
make more candidates; extra columns are ignored; an empty table gives no rows. Spans are code
points, end exclusive, leftmost and non-overlapping within a rule; a match that fails the length
rule is consumed like any other and then left out.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that an exact part of an expression may stand for before it counts as any string.
MAX_STRINGS = 48


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # the part whose length counts
    least: int = 1


#: The base kinds first, in the order in which ties sort; then further kinds.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
]
BASE = ("assign", "access", "hex")

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; an empty AND holds for every text
ANY: Query = frozenset([frozenset()])


def least(branches) -> Query:
    branches = set(branches)
    return frozenset(b for b in branches if not any(o < b for o in branches))


def both(a: Query, b: Query) -> Query:
    return least(x | y for x in a for y in b)


def of_strings(strings: set[str]) -> Query:
    return least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def parsed(items) -> tuple[set[str] | None, Query]:
    """The strings that a part stands for (None: too many), and a query all its matches satisfy."""
    exact, query, whole = {""}, ANY, True
    for op, arg in items:
        strings, inner = part(op, arg)
        if strings is not None and len(strings) * len(exact) <= MAX_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        query = both(query, of_strings(exact))
        query = both(query, inner if strings is None else of_strings(strings))
        exact, whole = {""}, False
    return (exact, of_strings(exact)) if whole else (None, both(query, of_strings(exact)))


def part(op, arg) -> tuple[set[str] | None, Query]:
    if op is rc.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is rc.SUBPATTERN:
        return parsed(arg[-1])
    if op is rc.BRANCH:
        sides = [parsed(x) for x in arg[1]]
        if all(s is not None for s, _ in sides) and len(strings := set().union(*(s for s, _ in sides))) <= MAX_STRINGS:
            return strings, of_strings(strings)
        return None, least(b for s, q in sides for b in (of_strings(s) if s is not None else q))
    if op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
        return {chr(c).lower() for _, c in arg}, ANY
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, inner = arg
        strings, query = parsed(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        return None, query if low else ANY
    return None, ANY


def trigram_query(pattern: str) -> Query:
    return parsed(rp.parse(pattern))[1]


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, text_hash, kinds: the rules whose trigram query a document satisfies."""
    terms = [(r.kind, n, t, len(branch)) for r in rules if (q := trigram_query(r.pattern)) != ANY for n, branch in enumerate(sorted(q, key=sorted)) for t in sorted(branch)]
    wanted = docs.sparkSession.createDataFrame(terms, "kind string, branch int, trigram string, needed int")
    vocabulary = F.array(*[F.lit(t) for t in sorted({t[2] for t in terms})])
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lower("text").alias("low"))
    found = F.transform(F.array(F.col("low")), lambda low: F.filter(vocabulary, lambda t: F.contains(low, t)))[0]
    # the outer form: of the inner one Spark derives filters that would search the texts again
    postings = own.select("doc_id", "text_hash", F.explode_outer(found).alias("trigram")).where("trigram is not null")
    met = postings.join(F.broadcast(wanted), "trigram")  # a row for each trigram of the rules
    branches = met.groupBy("doc_id", "text_hash", "kind", "branch").agg(F.count_distinct("trigram").alias("n"), F.max("needed").alias("needed"))
    return branches.where("n = needed").groupBy("doc_id", "text_hash").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Sorted (start, order, end, kind) of a rule's matches. The pieces between matches and the
    matches themselves are read off in turn, so places need no search."""
    kept = F.array_repeat(F.struct(F.lit(0).alias("start"), F.lit(0).alias("kind_order"), F.lit(0).alias("end"), F.lit("").alias("kind")), 0)
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("sized"),
        F.slice(F.split(text, rule.pattern, -1), 1, F.greatest(F.lit(1), F.size(F.split(text, rule.pattern, -1)) - 1)).alias("before"),
    )
    step = F.aggregate(
        F.when(F.rlike(text, F.lit(rule.pattern)), found),
        F.struct(F.lit(0).alias("at"), kept.alias("out")),
        lambda a, m: F.struct(
            (a["at"] + F.length(m["before"]) + F.length(m["whole"])).alias("at"),
            F.when(F.length(m["sized"]) < rule.least, a["out"]).otherwise(
                F.concat(a["out"], F.array(F.struct((a["at"] + F.length(m["before"])).alias("start"), F.lit(order).alias("kind_order"), (a["at"] + F.length(m["before"]) + F.length(m["whole"])).alias("end"), F.lit(rule.kind).alias("kind"))))
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.coalesce(step, kept)


def quick(rule: Rule) -> str:
    """An expression that finds a text's first match long enough, to pass over most texts."""
    return rule.pattern[:-1] + f"{{{rule.least},}}" if rule.pattern.startswith("[") else rule.pattern


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id and spans: an array of (start, kind_order, end, kind), sorted."""
    rules = RULES if rules is None else rules
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = candidates(docs, rules).select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), "kinds")
    joined = docs.join(held, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.xxhash64("text") == F.col("c_hash")), "left")
    found = []
    for i, rule in enumerate(rules):
        test = F.rlike("text", F.lit(quick(rule))) if trigram_query(rule.pattern) == ANY else F.array_contains("kinds", rule.kind)
        found.append(F.when(test, spans(F.col("text"), rule, i)))
    empty = F.array_repeat(F.struct(F.lit(0).alias("start"), F.lit(0).alias("kind_order"), F.lit(0).alias("end"), F.lit("").alias("kind")), 0)
    every = reduce(F.concat, [F.coalesce(f, empty) for f in found])
    return joined.select("doc_id", F.array_sort(every).alias("spans"))


def listed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(kind: str) -> Column:
    return F.filter("spans", lambda x: x["kind"] == kind)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs)
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

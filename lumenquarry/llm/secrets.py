"""Operator 5, secret scans: a trigram index names candidates, regular expressions verify them.

From each rule's expression a Boolean query over lower-case trigrams is derived that holds for every text with a match.
The index has a posting (trigram, text), a text known by a 64-bit hash, for every trigram of the queries and every text
that holds it. Postings are intersected by text: a mask of the trigrams present, over which the query is evaluated. Rules
without a mandatory trigram (the query is true) scan all texts.

Candidates, whatever their number, are joined with the texts: by broadcast while their counted size is under
common.BROADCAST_BYTES; beyond that a sieve of bounded size passes the texts concerned (and a few others), which alone
are shuffled. Native throughout.

Spans are in code points, end exclusive. Positions of matches come from the lengths of the matches and of the pieces
between them, summed in blocks, so many matches in one text stay cheap.

Null or empty text: no spans. Very long texts: whole. Repeated rows: each is scanned; equal texts share postings, and
texts that share a hash can only add candidates. Null or equal doc_ids: rows like others. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _parser as regex_tree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """least: characters that group `group` of a match must have. base: part of the base digest."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The rules, in the order in which spans of one start are listed.
RULES = (
    Rule("assign", "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", "[0-9a-f]{32,}", 0, 32, True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub", "gh[pousr]_[A-Za-z0-9]{36,}"),
)

# --- Boolean trigram queries: a trigram, True, or (op, parts) with op "and" or "or" ---
Query = str | bool | tuple[str, tuple]
MOST_STRINGS = 64


def both(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def any_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    atoms = {p: frozenset(p[1] if isinstance(p, tuple) and p[0] == "and" else [p]) for p in parts}
    parts = [p for p in parts if not any(atoms[q] < atoms[p] for q in parts)]  # a or (a and b) is a
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_strings(strings: set[str]) -> Query:
    return any_of([both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def query_of(pattern: str) -> Query:
    """A query that holds for the lower-cased form of every text in which the pattern matches."""
    strings, query = walk(regex_tree.parse(pattern))
    return query if strings is None else both([query, of_strings(strings)])


def walk(nodes) -> tuple[set[str] | None, Query]:
    """The strings that nodes can match, lower-cased, where they are few, and a query for what else is mandatory."""
    parts: list[Query] = []
    run: set[str] = {""}
    whole = True
    for op, arg in nodes:
        strings, query = one(str(op), arg)
        parts.append(query)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            parts.append(of_strings(run))
            run, whole = ({""} if strings is None else strings), False
    if whole:
        return run, both(parts)
    return None, both([*parts, of_strings(run)])


def one(op: str, arg) -> tuple[set[str] | None, Query]:
    if op == "LITERAL":
        return {chr(arg).lower()}, True
    if op == "IN":
        chars: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op == "SUBPATTERN":
        return walk(arg[-1])
    if op == "BRANCH":
        walked = [walk(b) for b in arg[1]]
        if all(s is not None and q is True for s, q in walked) and sum(len(s) for s, _ in walked) <= MOST_STRINGS:
            return set().union(*[s for s, _ in walked]), True
        return None, any_of([q if s is None else both([q, of_strings(s)]) for s, q in walked])
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        strings, query = walk(inner)
        if (low, int(high)) == (0, 1) and strings is not None and query is True:
            return strings | {""}, True
        if low == 0:
            return None, True
        return None, query if strings is None else both([query, of_strings(strings)])
    return None, True


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, tuple):
        return set().union(*map(trigrams_of, query[1]))
    return {query} if isinstance(query, str) else set()


@dataclass(frozen=True)
class Plan:
    """The queries of rules and the trigrams they ask for; bit k of word k // 62 of a mask stands for trigram k."""

    queries: tuple[Query, ...]
    trigrams: tuple[str, ...]

    def holds(self, query: Query, masks: list[Column]) -> Column:
        if isinstance(query, tuple):
            parts = [self.holds(q, masks) for q in query[1]]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if query[0] == "and" else out | p
            return out
        if isinstance(query, str):
            k = self.trigrams.index(query)
            return masks[k // 62].bitwiseAND(F.lit(1 << k % 62)) != 0
        return F.lit(True)

    def rules(self, masks: list[Column]) -> Column:
        """A bit for each rule whose query isn't true for all texts and holds."""
        out = F.lit(0)
        for k, q in enumerate(self.queries):
            if q is not True:
                out = out + F.when(self.holds(q, masks), 1 << k).otherwise(0)
        return out


def plan_of(rules: tuple[Rule, ...] = RULES) -> Plan:
    queries = tuple(query_of(r.pattern) for r in rules)
    return Plan(queries, tuple(sorted(set().union(*map(trigrams_of, queries)))))


def bit(trigram: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (trigram % 62).cast("int"))


def present(text: Column, plan: Plan) -> Column:
    """The numbers of the trigrams that a text holds."""
    return let(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), k) for k, t in enumerate(plan.trigrams)])))


def build_index(docs: DataFrame, plan: Plan) -> DataFrame:
    """Postings: trigram (its number) and key (the text's hash), one row for each trigram of a document."""
    return docs.where(F.col("text") != "").select(F.xxhash64("text").alias("key"), F.explode(present(F.col("text"), plan)).alias("trigram"))


def candidates(postings: DataFrame, plan: Plan) -> DataFrame:
    """key and the rules its text may match: the postings' intersection for each text."""
    words = -(-len(plan.trigrams) // 62)
    masks = [F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w, bit(F.col("trigram"))).otherwise(0)).alias(f"m{w}") for w in range(words)]
    met = postings.groupBy("key").agg(*masks)
    return met.select("key", plan.rules([F.col(f"m{w}") for w in range(words)]).alias("rules")).where("rules > 0")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda s, x: s + x)


def spans(text: Column, rule: Rule, order: int, block: int = 256) -> Column:
    """Start, kind's number, end of the rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x)).alias("size"),
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)).alias("tested"),
    )

    def placed(f: Column) -> Column:
        steps = F.zip_with(F.slice(f["gap"], F.lit(1), F.size(f["size"])), f["size"], lambda g, s: g + s)
        sums = lambda st: F.transform(F.sequence(F.lit(0), F.floor(F.size(st) / block).cast("int")), lambda b: total(F.slice(st, b * block + 1, F.lit(block))))

        def at(x: Column) -> Column:
            before = lambda i: total(F.slice(x["sums"], F.lit(1), F.floor(i / block).cast("int"))) + total(F.slice(x["steps"], F.floor(i / block).cast("int") * block + 1, i % block))
            return F.transform(
                F.sequence(F.lit(0), F.size(f["size"]) - 1),
                lambda i: F.when(F.get(f["tested"], i) >= rule.least, let(before(i) + F.get(f["gap"], i), lambda s: F.struct(s.alias("start"), F.lit(order).alias("kind"), (s + F.get(f["size"], i)).alias("end")))),
            )

        return F.array_compact(let(let(steps, lambda st: F.struct(st.alias("steps"), sums(st).alias("sums"))), at))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.rlike(text, pattern), let(found, placed)).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and `found`, an array of (start, kind's number, end) in the order of start and kind, for every row."""
    plan = plan_of(rules)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = common.cut(candidates(build_index(docs, plan), plan))
    n = met.count()
    keyed = docs.withColumn("key", F.xxhash64("text"))
    if n * 48 <= common.BROADCAST_BYTES:
        rows = keyed.join(F.broadcast(met), "key", "left")
    else:
        maybe, other = common.sieved(keyed, F.col("key"), met.select(F.col("key").alias("h")), n)
        rows = maybe.join(met.hint("shuffle_merge"), "key", "left").unionByName(other.withColumn("rules", F.lit(None).cast("int")))
    found = []
    for k, (rule, query) in enumerate(zip(rules, plan.queries, strict=True)):
        s = spans(F.col("text"), rule, k)
        found.append(s if query is True else F.when(F.col("rules").bitwiseAND(F.lit(1 << k)) != 0, s).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def listed(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(common.table(spark, sf_dir, "documents"))
    base = [k for k, r in enumerate(RULES) if r.base]
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    counted = [count(k).alias(f"n_{RULES[k].kind}") for k in base]
    return rows.select("doc_id", *counted, F.sha2(listed(F.filter("found", lambda x: x["kind"] <= max(base))), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _sql() -> str:
    """Matches and the pieces between them give the positions, as above."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"select r, {k} k, '{r.kind}' kind, unnest(range(1, len(m) + 1)) i, m, g, p from (select r, regexp_extract_all(t, '{p}') m, regexp_extract_all(t, '{p}', {r.group}) g, string_split_regex(t, '{p}') p from d)"
        )
    least = " ".join(f"when {k} then {r.least}" for k, r in enumerate(RULES))
    base = ", ".join(str(k) for k, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"count(*) filter (k = {k})::bigint n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    return f"""
with d as (select doc_id, coalesce(text, '') t, row_number() over () r from documents),
f as ({" union all ".join(parts)}),
s as (select r, k, kind, length(m[i]) n, length(g[i]) tested,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) a from f),
o as (select r, k, kind || ':' || a::bigint || ':' || (a + n)::bigint v, a from s where tested >= case k {least} end),
c as (select r, {counts}, sha256(coalesce(string_agg(v, ',' order by a, k) filter (k in ({base})), '')) base_sha256, string_agg(v, ',' order by a, k) spans from o group by r)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
    coalesce(base_sha256, sha256('')) base_sha256, coalesce(spans, '') spans from d left join c using (r)
"""


OP5_SQL = _sql()

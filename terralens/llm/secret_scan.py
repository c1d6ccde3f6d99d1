"""Secret scans over a trigram inverted index, in DataFrame functions alone.

1. Each rule's regular expression is turned into a Boolean query of folded trigrams that any match must contain, in
   disjunctive form. A rule without mandatory trigrams has no query and scans every text.
2. The index's dictionary is the union of the rules' trigrams. Documents fall into blocks by a hash; for each block and
   trigram the index holds the posting list of the documents that contain it. A block has a bounded number of
   documents, so no posting list grows with the table, however common its trigram.
3. In each block the posting lists of a clause are intersected and the clauses' results united: the candidates.
4. Candidates are verified with the rule's own expression, which gives the spans.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.llm._tables import free, table, texts, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
BASE_RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # the runs of [0-9a-f]+ with 16 characters or more, without listing the shorter ones
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
RULES = (
    *BASE_RULES,
    Rule("github", r"gh[ps]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[bp]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# --- from expressions to trigram queries ------------------------------------------------------------------------

#: A query is a set of clauses, any of which must hold; a clause is a set of trigrams, all of which must occur.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])
_MOST_STRINGS = 64


def _simplified(query: Query) -> Query:
    """Without clauses that another clause implies."""
    return frozenset(c for c in query if not any(other < c for other in query))


def _of_strings(strings: set[str]) -> Query:
    return _simplified(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _both(a: Query, b: Query) -> Query:
    joined = _simplified(frozenset(x | y for x, y in product(a, b)))
    return joined if len(joined) <= _MOST_STRINGS else min(a, b, key=len)


def _analysed(items) -> tuple[set[str] | None, Query]:
    """What a sequence matches: all its strings if they are few, and what must occur in any match."""
    strings: set[str] | None = {""}
    must = ANYTHING
    whole = True  # strings cover the sequence from its start
    for op, arg in items:
        exact, need = _one(op, arg)
        if exact is not None and len(strings) * len(exact) <= _MOST_STRINGS:
            strings = {a + b for a in strings for b in exact}
            continue
        must = _both(must, _of_strings(strings))
        must = _both(must, need if exact is None else _of_strings(exact))
        strings, whole = {""} if exact is None else exact, False
    if whole:
        return strings, _of_strings(strings)
    return None, _both(must, _of_strings(strings))


def _one(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANYTHING
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANYTHING
        return (chars, ANYTHING) if len(chars) <= 8 else (None, ANYTHING)
    if op is sre.SUBPATTERN:
        return _analysed(arg[-1])
    if op is sre.BRANCH:
        arms = [_analysed(a) for a in arg[1]]
        if all(e is not None for e, _ in arms):
            strings = set().union(*(e for e, _ in arms))
            return strings, _of_strings(strings)
        return None, _simplified(frozenset().union(*(q for _, q in arms)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        exact, need = _analysed(inner)
        if exact is not None and least == 0 and most == 1:
            return exact | {""}, ANYTHING
        if exact is not None and least == most and len(exact) ** least <= _MOST_STRINGS:
            return {"".join(x) for x in product(exact, repeat=least)}, ANYTHING
        return None, need if least else ANYTHING
    if op is sre.AT:
        return {""}, ANYTHING
    return None, ANYTHING


def trigram_query(pattern: str) -> Query | None:
    """The trigrams, folded to lower case, that any match contains; None where none is mandatory."""
    query = _analysed(_parser.parse(pattern))[1]
    return None if frozenset() in query else query


# --- the index --------------------------------------------------------------------------------------------------


def _key() -> Column:
    """A row's name in the index. Equal rows share it, and two rows that happen to share it are only verified more."""
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, trigrams: list[str], block_rows: int = 8192) -> DataFrame:
    """(block, t0, t1, ...): for each block of about `block_rows` documents the posting list of each trigram.

    The trigrams of a text are found once and travel as bits; lists are filled map-side before the shuffle.
    """
    blocks = max(1, -(-docs.count() // block_rows))
    folded = docs.select(_key().alias("key"), F.lower("text").alias("folded"))
    words = range(0, len(trigrams), 60)
    bits = [sum((F.contains("folded", F.lit(t)).cast("long") * F.lit(1 << i) for i, t in enumerate(trigrams[at : at + 60])), F.lit(0)).alias(f"bits{at // 60}") for at in words]
    marked = folded.select("key", *bits)
    some = marked.filter(sum((F.col(f"bits{at // 60}").bitwiseAND(F.lit(-1)) != 0).cast("int") for at in words) > 0) if trigrams else marked.limit(0)
    lists = [F.collect_set(F.when(F.col(f"bits{i // 60}").bitwiseAND(F.lit(1 << i % 60)) != 0, F.col("key"))).alias(f"t{i}") for i in range(len(trigrams))]
    return some.groupBy(F.pmod("key", F.lit(blocks)).alias("block")).agg(*lists or [F.count("*").alias("n")])


def candidates(index: DataFrame, trigrams: list[str], queries: list[Query | None]) -> DataFrame:
    """(key, rules): for each document that some rule's query admits, the rules as bits."""
    place = {t: f"t{i}" for i, t in enumerate(trigrams)}
    found = []
    for k, query in enumerate(queries):
        if query is None:
            continue
        clauses = []
        for clause in sorted(query, key=sorted):
            hit: Column | None = None
            for t in sorted(clause):
                hit = F.col(place[t]) if hit is None else F.array_intersect(hit, F.col(place[t]))
            clauses.append(hit)
        union = clauses[0]
        for c in clauses[1:]:
            union = F.array_union(union, c)
        found.append(F.struct(F.lit(1 << k).cast("long").alias("rule"), union.alias("keys")))
    if not found:
        return index.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("rules")).limit(0)
    hits = index.select(F.explode(F.array(*found)).alias("x")).select("x.rule", F.explode("x.keys").alias("key"))
    return hits.groupBy("key").agg(F.bit_or("rule").alias("rules"))


def _spans(rule: Rule, order: int) -> Column:
    """The rule's spans in a text, by start; offsets count code points.

    Splitting at the matches gives what lies between them, so each start is a running sum of lengths.
    """
    long = lambda c: F.char_length(c).cast("long")
    between = F.split("text", rule.pattern, -1)
    matches = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    parts = F.transform(F.arrays_zip(between.alias("gap"), matches.alias("hit"), held.alias("held")), lambda x: F.struct(long(x["gap"]).alias("gap"), long(x["hit"]).alias("hit"), long(x["held"]).alias("held")))
    none = "struct<at:bigint,out:array<struct<start:bigint,kind:int,end:bigint>>>"
    start = F.from_json(F.lit('{"at":0,"out":[]}'), none)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["hit"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["held"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = 250_000) -> DataFrame:
    """The columns of docs and `secrets`, the spans (start, kind, end) of every rule's matches, by start, then rule.

    kind is the rule's place in `rules`. Matches are leftmost and do not overlap in one rule; rules may overlap.
    Null texts count as empty and have no spans; repeated rows each have theirs; an empty table gives none; other
    columns pass through (one named `secrets` is replaced). Candidates join back by broadcast while they are counted
    at most `broadcast_rows` (16 bytes each), else by shuffle on the row's hash.
    """
    base = texts(docs, "doc_id")
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries if q for c in q for t in c})
    index = written(build_index(base, trigrams), "trigram-index")
    key, bits, whole = free(docs.columns, "__key", "__rules", "__text")
    hits = written(candidates(index, trigrams, queries), "secret-candidates").withColumnsRenamed({"key": key, "rules": bits})
    hits = F.broadcast(hits) if hits.count() <= broadcast_rows else hits
    others = [c for c in docs.columns if c not in ("text", "secrets")]
    rows = docs.select(*others, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("text").alias(whole))
    joined = rows.withColumn(key, _key()).join(hits, key, "left")
    none = F.array().cast(_SPANS)
    found = []
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        # a cheap look for any match first, so that texts without one are not taken apart
        asked = F.lit(True) if query is None else F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        found.append(F.when(asked & F.col("text").rlike(rule.pattern), _spans(rule, k)).otherwise(none))
    return joined.select(*others, F.col(whole).alias("text"), F.array_sort(F.concat(*found)).alias("secrets"))


def digest(secrets: Column, rules: tuple[Rule, ...], most: int | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; of the first `most` rules only, if given."""
    chosen = secrets if most is None else F.filter(secrets, lambda x: x["kind"] < most)
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Texts with every span replaced by the mark (spans that overlap become one), without `secrets`."""
    init = F.from_json(F.lit('{"at":0,"out":""}'), "struct<at:bigint,out:string>")

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] > acc["at"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))).otherwise(F.lit(""))
        new = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, F.when(new, F.lit(mark)).otherwise(F.lit(""))).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.char_length("text")))
    clean = F.when(F.size("secrets") > 0, F.aggregate("secrets", init, step, rest)).otherwise(F.col("text"))
    return scanned.withColumn("text", clean).drop("secrets")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each row of `documents`.

    Null texts count as empty and have no spans, repeated rows each have theirs, spans that start together stand in the
    order of rules, an empty table gives none, other columns are ignored; see scan.
    """
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)),
        F.sha2(digest(F.col("secrets"), RULES, len(BASE_RULES)), 256).alias("base_sha256"), digest(F.col("secrets"), RULES).alias("spans"),
    )


def spans_sql(text: str, rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB: the list of (start, kind, end) of all rules' spans in the SQL expression `text`, by start, then rule."""
    parts = []
    for k, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        hit, held, gap = f"regexp_extract_all({text}, '{pattern}', 0)", f"regexp_extract_all({text}, '{pattern}', {r.group})", f"string_split_regex({text}, '{pattern}')"
        size = "lambda s: length(s)"
        begin = f"coalesce(list_sum(list_transform({gap}[1:i], {size})), 0)::BIGINT + coalesce(list_sum(list_transform({hit}[1:i-1], {size})), 0)::BIGINT"
        parts.append(
            f"list_transform(list_filter(range(1, len({hit}) + 1), lambda i: length({held}[i]) >= {r.least}), "
            f"lambda i: {{'start': {begin}, 'kind': {k}, 'end': {begin} + length({hit}[i])}})"
        )
    joined = parts[0]
    for p in parts[1:]:
        joined = f"list_concat({joined}, {p})"
    return f"list_sort({joined})"


def _digest_sql(spans: str) -> str:
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    return f"coalesce(array_to_string(list_transform({spans}, lambda x: {names}[x.kind + 1] || ':' || x.start || ':' || x.\"end\"), ','), '')"


ORACLE_SQL = f"""
WITH found AS (SELECT doc_id, {spans_sql("coalesce(text, '')")} AS secrets FROM documents)
SELECT doc_id, {", ".join(f"len(list_filter(secrets, lambda x: x.kind = {k}))::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE_RULES))},
       sha256({_digest_sql(f"list_filter(secrets, lambda x: x.kind < {len(BASE_RULES)})")}) AS base_sha256, {_digest_sql("secrets")} AS spans
FROM found"""

"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: alternatives, each a set
of trigrams that every match must contain. The trigrams that some query names are
indexed (trigram -> documents); intersecting postings gives candidates, and only
those are searched with the regex. A rule without mandatory trigrams scans every text.
The index is over lower-cased text, so it never loses a match; the regex decides.

Hot trigrams are harmless: postings are intersected by document, with one row per
document and alternative after the map-side aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._text import fresh


def either_case(pattern: str) -> str:
    """ASCII letters of a literal pattern as two-letter classes; the same in every regex engine."""
    return re.sub(r"[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]", pattern)


@dataclass(frozen=True)
class Rule:
    """Matches of ``regex``, leftmost and non-overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule(
        "assign",
        "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    # runs are maximal, so asking for the length within the pattern finds the same runs
    Rule("hex", "[0-9a-f]{32,}", least=32),
)
#: Formats of widespread credentials beside the base kinds.
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("userinfo", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE_RULES + MORE_RULES

#: Classes of more characters, or more strings in a row, are taken as unknown text.
_CLASS, _STRINGS = 8, 64

Query = frozenset[frozenset[str]]
_ANY: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x, y in product(a, b))


def _trigrams(strings: set[str]) -> Query:
    """What holds if one of ``strings`` is in the text."""
    if not strings or any(len(s) < 3 for s in strings):
        return _ANY
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _exact(node: tuple) -> set[str] | None:
    """All texts that a regex node can match, lower-cased; None: too many."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
        chars = {c for o, a in arg for c in (range(a[0], a[1] + 1) if str(o) == "RANGE" else (a,))}
        return {chr(c).lower() for c in chars} if len(chars) <= _CLASS else None
    if op == "SUBPATTERN":
        return _exact_all(arg[-1])
    if op == "BRANCH":
        parts = [_exact_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and arg[1] <= 3:
        once = _exact_all(arg[2])
        return None if once is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(once, repeat=n)}
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = _exact(node)
        if part is None or len(out) * len(part) > _STRINGS:
            return None
        out = {a + b for a, b in product(out, part)}
    return out


def _query(nodes) -> Query:
    query, run = _ANY, {""}
    for node in nodes:
        part = _exact(node)
        if part is not None and len(part) * len(run) <= _STRINGS:
            run = {a + b for a, b in product(run, part)}
            continue
        query, run = _both(query, _trigrams(run)), part if part is not None and len(part) <= _STRINGS else {""}
        op, arg = str(node[0]), node[1]
        if part is not None:
            continue
        if op == "SUBPATTERN":
            query = _both(query, _query(arg[-1]))
        elif op == "BRANCH":
            query = _both(query, frozenset().union(*map(_query, arg[1])))
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            query = _both(query, _query(arg[2]))
    return _both(query, _trigrams(run))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams, one of which any match contains in full; [] if there is none."""
    query = _query(re._parser.parse(regex))
    least = [x for x in query if not any(y < x for y in query)]
    return [] if frozenset() in query else sorted(least, key=sorted)


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the kinds whose trigram query holds in the document's text (or, for
    repeated doc_ids, in its texts together)."""
    spark = docs.sparkSession
    alternatives = [
        (rule.kind, nth, trigram, 1 << bit, (1 << len(alternative)) - 1)
        for rule in rules
        for nth, alternative in enumerate(trigram_query(rule.regex))
        for bit, trigram in enumerate(sorted(alternative))
    ]
    terms = sorted({a[2] for a in alternatives})
    low = docs.select("doc_id", F.lower("text").alias("low"))
    postings = low.select(
        "doc_id", F.explode(F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in terms)))).alias("trigram")
    )
    # as many rows as the rules have trigrams, whatever the data
    wanted = F.broadcast(spark.createDataFrame(alternatives, "kind string, nth int, trigram string, bit long, whole long"))
    return (
        postings.join(wanted, "trigram")
        .groupBy("doc_id", "kind", "nth", "whole")
        .agg(F.bit_or("bit").alias("found"))
        .where("found = whole")
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _matches(text: Column, rule: Rule) -> tuple[Column, Column, Column]:
    """The texts between matches, the matches, and whether each of these is long enough."""
    regex = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, regex, F.lit(rule.group))
    return F.split(text, rule.regex, -1), whole, F.transform(part, lambda x: F.length(x) >= rule.least)


_CHUNK = 256


def _states(xs: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each element. By chunks, as an array that grows is copied at each step."""
    last = lambda states: F.element_at(states, -1)
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(xs) / _CHUNK).cast("int")), lambda j: F.slice(xs, j * _CHUNK + 1, _CHUNK)
    )
    within = lambda chunk, state: F.aggregate(chunk, F.array(state), lambda a, x: F.concat(a, F.array(step(last(a), x))))
    parts = F.aggregate(chunks, F.array(F.array(first)), lambda a, c: F.concat(a, F.array(within(c, last(last(a))))))
    # each part begins with the state that it went on from
    return F.flatten(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.slice(p, F.lit(2), F.size(p))))


def spans(text: Column, rule: Rule, nth: int, size: Callable[[Column], Column] = F.length) -> Column:
    """array<struct<start, nth, end>> of the rule's matches, end exclusive; in code points, or what else ``size`` counts."""
    between, whole, good = _matches(text, rule)
    found = F.transform(F.arrays_zip(between.alias("gap"), whole.alias("own")), lambda x: F.struct(size(x["gap"]).alias("gap"), size(x["own"]).alias("own")))
    # what is between comes once more often than matches
    found = F.slice(found, F.lit(1), F.size(whole))
    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    at = _states(found, none, lambda s, x: F.struct((s["end"] + x["gap"]).alias("start"), (s["end"] + x["gap"] + x["own"]).alias("end")))
    kept = F.filter(F.arrays_zip(at.alias("at"), good.alias("good")), lambda x: x["good"])
    return F.transform(kept, lambda x: F.struct(x["at"]["start"].alias("start"), F.lit(nth).alias("nth"), x["at"]["end"].alias("end")))


def _all_spans(rules: tuple[Rule, ...], search: dict[str, Column], size: Callable[[Column], Column] = F.length) -> Column:
    none = F.expr("CAST(array() AS array<struct<start:int,nth:int,end:int>>)")
    each = [F.when(search[r.kind], spans(F.col("text"), r, i, size)).otherwise(none) for i, r in enumerate(rules)]
    return F.array_sort(F.flatten(F.array(*each)))


def _flagged(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """The documents joined with the kinds they are candidates of; by kind, whether to search a row."""
    id_, kinds = fresh(docs, "_id", "_kinds")
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    found = candidates(docs, rules).select(F.col("doc_id").alias(id_), F.col("kinds").alias(kinds))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)), "left").drop(id_)
    search = {
        rule.kind: F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False))
        if trigram_query(rule.regex)
        else F.col("text").rlike(rule.regex)
        for rule in rules
    }
    return joined, search


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id and ``found``, an array of (start, kind, end) by start and rule order.

    Null texts count as empty; null or repeated doc_ids and repeated rows keep a row each;
    of all columns only doc_id and text are read. No documents: no rows.
    """
    joined, search = _flagged(docs.select("doc_id", "text"), rules)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return joined.select("doc_id", _all_spans(rules, search).alias("_found")).select(
        "doc_id",
        F.transform(
            "_found", lambda x: F.struct(x["start"].alias("start"), F.get(kinds, x["nth"]).alias("kind"), x["end"].alias("end"))
        ).alias("found"),
    )


def _merged(found: Column) -> Column:
    """array<struct<start, end>> of what sorted spans cover together; spans that only touch stay apart."""
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    grown = _states(
        found,
        none,
        lambda s, x: F.when(x["start"] < s["end"], F.struct(s["start"].alias("start"), F.greatest(s["end"], x["end"]).alias("end"))).otherwise(
            F.struct(x["start"].alias("start"), x["end"].alias("end"))
        ),
    )
    following = F.slice(grown, F.lit(2), F.size(grown))
    return F.transform(
        F.filter(F.arrays_zip(grown.alias("own"), following.alias("next")), lambda x: x["next"].isNull() | (x["next"]["start"] != x["own"]["start"])),
        lambda x: x["own"],
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """The documents with what ``scan`` finds replaced by ``mask``, and n_chars brought up to date.

    All matches are found in the original text; those that overlap or lie in each other are
    replaced together, once, so nothing of any of them is left. Other columns, and texts without
    a match (null and empty ones too), stay as they are; repeated rows are each masked.
    """
    columns = docs.columns
    old, cut = fresh(docs, "_text", "_spans")
    joined, search = _flagged(docs.withColumn(old, F.col("text")), rules)
    # offsets in bytes: a piece of a binary is found without counting code points before it
    joined = joined.withColumn(cut, _all_spans(rules, search, F.octet_length)).withColumn(cut, _merged(F.col(cut)))
    data = F.col("text").cast("binary")
    piece = lambda a, b: F.substring(data, a + 1, b - a).cast("string")
    ends = F.concat(F.array(F.lit(0)), F.transform(cut, lambda x: x["end"]))
    starts = F.concat(F.transform(cut, lambda x: x["start"]), F.array(F.octet_length("text")))
    clean = F.array_join(F.zip_with(ends, starts, piece), mask)
    joined = joined.withColumn("text", F.when(F.size(cut) > 0, clean).otherwise(F.col(old)))
    if "n_chars" in columns:
        chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(F.size(cut) > 0, chars).otherwise(F.col("n_chars")))
    return joined.select(*columns)


def spans_text(found: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

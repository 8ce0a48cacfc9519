"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: whatever matches must contain them (after
lower-casing). Postings of the trigrams that some query names are built per block of documents,
intersected and united block by block, and only the documents found are searched with the pattern. A
pattern without mandatory trigrams is searched in every document.

Cox, "Regular Expression Matching with a Trigram Index", 2012.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents whose postings form one list.
BLOCK_DOCS = 2048
#: Strings a part of a pattern may stand for before it counts as open.
MOST_STRINGS = 64
#: Trigrams that a conjunction names.
MOST_TRIGRAMS = 4


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Kinds in the order in which they are listed. The first three are the base kinds.
BASE = (
    Rule(
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A query is ("all", parts), ("any", parts) or a trigram; None asks for nothing.
Query = tuple | str | None


def _both(kind: str, parts: list[Query]) -> Query:
    """Parts under "all" or "any", without repeats, empty parts and parts that another implies."""
    if kind == "any" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    if kind == "all":
        # Any part of a conjunction is a necessary condition; a few trigrams select well enough.
        plain = [p for p in parts if isinstance(p, str)]
        parts = [p for p in parts if not isinstance(p, str)] + plain[:MOST_TRIGRAMS]
    else:
        plain = {p: {p} if isinstance(p, str) else set(p[1]) for p in parts if isinstance(p, str) or p[0] == "all"}
        parts = [p for p in parts if p not in plain or not any(plain[o] < plain[p] for o in plain)]
    return parts[0] if len(parts) == 1 else (kind, tuple(parts)) if parts else None


def _of_strings(strings: set[str]) -> Query:
    """What a text that contains one of ``strings`` must contain."""
    return _both("any", [_both("all", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern, None if it has no mandatory trigram.

    Walks the parsed pattern and keeps the set of strings that the part seen last may stand for. When that set
    cannot go on (open repeats, large classes), its trigrams are required and a new set begins.
    """
    parse = re._parser  # type: ignore[attr-defined]  # the standard library's own reading of a pattern

    def walk(items) -> tuple[list[Query], set[str]]:
        needed: list[Query] = []
        strings = {""}

        def stop() -> None:
            nonlocal strings
            needed.append(_of_strings(strings))
            strings = {""}

        for op, value in items:
            name = str(op)
            options: set[str] | None = None
            if name == "LITERAL":
                options = {chr(value).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
                options = {chr(v).lower() for _, v in value}
            elif name == "SUBPATTERN":
                inner, options = walk(value[3])
                if any(q is not None for q in inner):
                    stop()
                    needed.extend(inner)
                    needed.append(_of_strings(options))
                    options = None
            elif name == "BRANCH":
                walked = [walk(b) for b in value[1]]
                if all(not any(q is not None for q in n) for n, _ in walked):
                    options = set().union(*(s for _, s in walked))
                else:
                    stop()
                    needed.append(_both("any", [_both("all", [*n, _of_strings(s)]) for n, s in walked]))
            elif name == "MAX_REPEAT" and value[1] == 1 and value[0] == 0:
                inner, once = walk(value[2])
                options = once | {""} if not any(q is not None for q in inner) else None
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                inner, once = walk(value[2])
                stop()
                needed.extend([*inner, _of_strings(once)])
            if options is None or len(options) * len(strings) > MOST_STRINGS or options == {""}:
                stop()
            else:
                strings = {s + o for s in strings for o in options}
        return needed, strings

    needed, strings = walk(parse.parse(pattern))
    return _both("all", [*needed, _of_strings(strings)])


def _trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def postings(docs: DataFrame, trigrams: list[str], key: str = "_key", text: str = "_text") -> DataFrame:
    """(block, trigram, keys): documents of a block that contain the trigram, without regard to case."""
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    low = docs.select(F.col(key).alias("_key"), F.lower(text).alias("_low"))
    held = F.filter(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return (
        low.select("_key", F.explode(held).alias("trigram"))
        .groupBy(F.pmod("_key", F.lit(blocks)).alias("block"), "trigram")
        .agg(F.collect_set("_key").alias("keys"))
    )


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(_key, _kinds): documents that satisfy the query of some rule, with those rules."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def found(query: Query) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.get(F.array(F.col("lists")[query]), 0), none)
        return reduce(F.array_intersect if query[0] == "all" else F.array_union, map(found, query[1]))

    def named(kind: str) -> Column:
        return F.transform(found(queries[kind]), lambda k: F.struct(k.alias("_key"), F.lit(kind).alias("kind")))

    rows = [named(kind) for kind in queries]
    hits = lists.select(F.explode(F.concat(*rows)).alias("hit")).select("hit.*")
    return hits.groupBy("_key").agg(F.collect_set("kind").alias("_kinds"))


def _spans(rule: Rule, place: int, text: Column) -> Column:
    """(start, place, end, kind) of the rule's matches in code points, end exclusive.

    The pieces between the matches and the matches themselves give the positions.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(F.length(x["group"]) >= rule.least, F.array(span)).otherwise(empty)
        return F.struct(end.alias("at"), F.concat(acc["spans"], kept).alias("spans"))

    zipped = F.arrays_zip(
        F.slice(pieces, F.lit(1), F.size(whole)).alias("piece"), whole.alias("whole"), group.alias("group")
    )
    return F.when(
        F.size(whole) > 0,
        F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"],
    ).otherwise(empty)


def secret_spans(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, place, end, kind), by start and then by rule.

    Offsets count code points of the whole text, the end is exclusive; matches of one rule do not
    overlap, matches of different rules may. Null and empty texts have no spans. Every row is
    kept, repeated rows and null ids included; other columns are left as they are (a column named
    ``secret_spans`` or starting with ``_key``, ``_text`` or ``_kinds`` would be replaced).
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q is not None}
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumn("_key", F.xxhash64(F.col(doc_id), body))
    if asked:
        trigrams = sorted(set().union(*map(_trigrams, asked.values())))
        index = postings(keyed.select("_key", body.alias("_text")), trigrams)
        keyed = keyed.join(candidates(index, asked), "_key", "left")
    spans = []
    for place, rule in enumerate(rules):
        own = _spans(rule, place, body)
        if rule.kind in asked:
            none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
            own = F.when(F.array_contains("_kinds", rule.kind), own).otherwise(none)
        spans.append(own)
    found = keyed.withColumn("secret_spans", F.array_sort(F.concat(*spans)))
    return found.drop("_key", *(["_kinds"] if asked else []))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame, mark: str = "<secret>", text: str = "text", **options) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping secrets share one mark."""
    found = secret_spans(docs, text=text, **options)
    body = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        more = F.when(s["start"] >= acc["at"], F.concat(between, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    done = F.aggregate("secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = F.substring(body, done["at"] + 1, F.length(body))
    return found.withColumn(
        text, F.when(F.size("secret_spans") > 0, F.concat(done["out"], rest)).otherwise(body)
    ).drop("secret_spans")

"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over lower-cased trigrams is derived: a disjunction of sets of
trigrams that must all be present. The index has one posting for each text and each trigram that some
query names; postings are intersected by text and clause, and the rule's regex verifies what is left.
A rule without mandatory trigrams (such as runs of hex digits) scans every text.

A text's place in the index is a hash of its id and content. Two texts that share a hash would only
share candidates, which are verified on each text, so that results don't depend on the hash.

Defined results: null text is taken as empty and has no spans. Whole texts are read. Equal rows get equal
results, one for each row. Positions are code points from 0, ends exclusive. Null ids are kept. An empty
table gives an empty table. Input columns other than the one that is added pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, unpacked


@dataclass(frozen=True)
class Rule:
    """A kind of secret. value: the group whose length counts (0: the whole match); matches of less than `least` are dropped."""

    kind: str
    regex: str
    least: int = 0
    value: int = 0


#: The base rules, in the order that breaks ties of spans that start together.
BASE_RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Documented prefixes of common credentials.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
#: Matches of a text whose places are added up together.
PIECE = 256


def _strings(part, limit: int = 64) -> set[str] | None:
    """All strings that a parsed part can match, lower-cased, if they are few."""
    op, arg = str(part[0]), part[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        if all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            return {chr(c).lower() for _, c in arg}
        return None
    if op == "SUBPATTERN":
        return _sequence(arg[3], limit)
    if op == "BRANCH":
        found = [_sequence(b, limit) for b in arg[1]]
        return None if any(f is None for f in found) else set().union(*found)
    if op == "MAX_REPEAT":
        least, most, what = arg
        inner = _sequence(what, limit)
        if inner is None or int(most) > 5:
            return None
        return set().union(*[{"".join(p) for p in product(inner, repeat=k)} for k in range(int(least), int(most) + 1)])
    return None


def _sequence(parts, limit: int = 64) -> set[str] | None:
    out = {""}
    for p in parts:
        s = _strings(p, limit)
        if s is None or len(out) * len(s) > limit:
            return None
        out = {a + b for a, b in product(out, s)}
    return out


def _flat(parts):
    """The parts of a sequence, groups that aren't small enough to spell out taken apart."""
    for p in parts:
        if str(p[0]) == "SUBPATTERN" and _strings(p) is None:
            yield from _flat(p[1][3])
        else:
            yield p


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Clauses of which one must hold, each a set of trigrams that must all occur; None if there are no mandatory ones.

    Stretches of the regex that match few strings give clauses; the stretch whose shortest string is
    longest is used.
    """
    runs, run = [], {""}
    for p in _flat(re._parser.parse(regex)):
        s = _strings(p)
        if s is not None and len(run) * len(s) <= 64:
            run = {a + b for a, b in product(run, s)}
        else:
            runs.append(run)
            repeated = str(p[0]) == "MAX_REPEAT" and p[1][0] > 0
            run = (_sequence(p[1][2]) or {""}) if repeated else {""}
            if repeated:
                runs.append(run)
                run = {""}
    best = max([*runs, run], key=lambda r: (min(map(len, r)), -len(r)))
    clauses = {trigrams(s) for s in best}
    if not all(clauses):
        return None
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, kind, end>> of a rule's matches: each match with the gap before it, so that lengths add up to positions."""
    gap_first = rf"\G(?s:(.*?))({rule.regex})"
    part = lambda g: F.regexp_extract_all(text, F.lit(gap_first), F.lit(g))
    joined = F.zip_with(part(1), F.arrays_zip(part(2).alias("m"), part(2 + rule.value).alias("v")), lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("counts")))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["counts"] >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    # arrays grow by being copied, so matches are taken in pieces, which are put one behind the other afterwards
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a lambda's argument is computed once
    last = lambda all_: F.greatest(F.ceil(F.size(all_) / PIECE).cast("int"), F.lit(1)) - 1
    pieces = lambda all_: F.transform(F.sequence(F.lit(0), last(all_)), lambda c: F.aggregate(F.slice(all_, c * PIECE + 1, PIECE), F.struct(F.lit(0).alias("at"), none.alias("found")), step))
    along = lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
    starts = lambda given: F.aggregate(given, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), along)["starts"]
    moved = lambda p, at: F.transform(p["found"], lambda f: F.struct((f["start"] + at).alias("start"), f["ord"].alias("ord"), f["kind"].alias("kind"), (f["end"] + at).alias("end")))
    return once(joined, lambda all_: once(pieces(all_), lambda given: F.flatten(F.zip_with(given, starts(given), moved))))


def _probe(rule: Rule) -> str:
    """For full scans: a regex that a text must match before its spans are looked for."""
    m = re.fullmatch(r"(\[[^\]]+\])\+", rule.regex)
    return f"{m[1]}{{{rule.least}}}" if m and not rule.value else rule.regex


def candidates(keyed: DataFrame, rules=RULES, key: str = "_key", text: str = "_text") -> DataFrame:
    """(key, rules): for each text that some query selects, the selected rules as bits."""
    spark = keyed.sparkSession
    terms = [(t, 1 << r, c, 1 << b, (1 << len(clause)) - 1) for r, rule in enumerate(rules) for c, clause in enumerate(trigram_query(rule.regex) or ()) for b, t in enumerate(sorted(clause))]
    query = spark.createDataFrame(terms, "trigram string, rule long, clause int, bit long, need long")
    starts: dict[str, set[str]] = {}
    for t, *_ in terms:
        starts.setdefault(t[0], set()).add(t[1:])
    quoted = lambda s: "".join(rf"\x{ord(c):02x}" for c in s)
    wanted = "|".join(f"{quoted(a)}(?:{'|'.join(map(quoted, sorted(rest)))})" for a, rest in sorted(starts.items()))
    any_start = "".join(map(quoted, sorted(starts)))
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?=[{any_start}])(?=({wanted}))"), F.lit(1)))
    postings = keyed.select(key, F.explode(found).alias("trigram"))
    clauses = postings.join(F.broadcast(query), "trigram").groupBy(key, "rule", "clause").agg(F.bit_or("bit").alias("has"), F.max("need").alias("need"))  # a few rows for each rule
    return clauses.where("has = need").groupBy(key).agg(F.bit_or("rule").alias("_rules"))


def find_secrets(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text", found: str = "secrets", columns: list[str] | None = None) -> DataFrame:
    """Adds array<struct<start, ord, kind, end>>, by start and then by the order of the rules.

    columns: the input's columns to return, all by default.
    """
    columns = [c for c in (columns or docs.columns) if c != found]
    keyed = docs.select(packed(docs, columns), F.coalesce(docs[text], F.lit("")).alias("_text"), F.xxhash64(docs[doc_id].cast("string"), docs[text]).alias("_key"))
    selected = cut(candidates(keyed, rules))  # a key and a number for each candidate: once written, its size tells whether texts must be shuffled to it
    both = keyed.join(selected, "_key", "left")
    spans, none = [], F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    for i, rule in enumerate(rules):
        if trigram_query(rule.regex) is None:
            look = F.col("_text").rlike(_probe(rule))
        else:
            look = F.coalesce(F.col("_rules"), F.lit(0)).bitwiseAND(1 << i) != 0
        spans.append(F.when(look, _spans(F.col("_text"), rule, i)).otherwise(none))
    return both.select(*unpacked(columns), F.array_sort(F.concat(*spans)).alias(found))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap one before them are merged into it."""
    none = F.lit("")

    def step(acc, s):
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(none))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

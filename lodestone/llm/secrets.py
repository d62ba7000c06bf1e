"""Secret scans, in DataFrame functions only: a trigram index narrows each rule to candidates, regexes verify them.

From each rule's pattern follows a Boolean query over lower-case trigrams. The index holds postings (trigram, id) of the
trigrams that any query names, taken from each text in one pass; no other trigram is ever asked for. A document's
postings are intersected as the queries say, and only candidates of a rule are read with its regex. Texts without a
single leading trigram have no posting: they stay where they are, and only the others meet the candidates by their ids.
A rule whose pattern has no mandatory trigram reads every text. Offsets are code points; they are running sums of the
lengths of the matches and of the stretches between them, so that the work grows with the text and its matches.

Null text: as the empty text, no spans. Very long texts, and texts with very many matches: read whole. Null doc_id:
matched as a value like any other. Repeated ids or rows: a rule's candidates are those of all rows with the id, and
verification settles each row. An empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


# The base rules, then the rules this scan adds.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + ADDED_RULES


#: Alternatives that a derived query may have, and members of a character class that are spelt out.
MOST_ALTERNATIVES, MOST_MEMBERS = 24, 5
#: Characters of the blocks from which a masked text is put together.
BLOCK = 4_096


def _runs(tree) -> list[tuple[str, ...]]:
    """Ways through a parsed pattern, each as its literal runs; an empty run stands where anything may come between."""
    ways: list[tuple[str, ...]] = [("",)]
    for op, arg in tree:
        kind, gap = str(op), [("", "")]
        if kind == "LITERAL":
            more = [(chr(arg).lower(),)]
        elif kind == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= MOST_MEMBERS:
            more = [(c,) for c in sorted({chr(a).lower() for _, a in arg})]
        elif kind == "BRANCH":
            more = [w for branch in arg[1] for w in _runs(branch)]
        elif kind == "SUBPATTERN":
            more = _runs(arg[-1])
        elif kind == "MAX_REPEAT" and (arg[0], arg[1]) == (0, 1):
            more = [("",), *_runs(arg[2])]
        elif kind == "MAX_REPEAT" and arg[0] > 0:
            more = [(*w, "") for w in _runs(arg[2])]
        else:
            more = gap
        if len(ways) * len(more) > MOST_ALTERNATIVES:
            more = gap
        ways = [(*w[:-1], w[-1] + m[0], *m[1:]) for w in ways for m in more]
    return ways


def trigram_query(rule: Rule) -> list[set[str]]:
    """The Boolean query of the rule's pattern: alternatives of lower-case trigrams that must all occur.

    Empty if some way through the pattern has no literal run of three: the rule then has no mandatory trigram.
    """
    ways = [{run[i : i + 3] for run in w for i in range(len(run) - 2)} for w in _runs(re._parser.parse(rule.pattern))]
    least = [w for w in ways if not any(o < w for o in ways)]
    return [w for n, w in enumerate(least) if w not in least[:n]] if all(ways) else []


#: Letters by their frequency in running text: a query's leading trigram is the one that looks rarest.
_FREQUENT = "zqxjkvbpygfwmucldrhsnioate"
SPANS = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _rarest(grams: set[str]) -> str:
    return min(grams, key=lambda g: (sum(map(_FREQUENT.find, g)), g))


def _any_of(grams: list[str]) -> str:
    """A regular expression of the alternatives, by their first letters."""
    first = {g[0]: [re.escape(x[1:]) for x in grams if x[0] == g[0]] for g in grams}
    return "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in first.items())


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(id, gram): the index of rows (id, text), for the trigrams that are asked for; overlapping ones all count."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"(?=({_any_of(grams)}))"), F.lit(1))
    return rows.select("id", F.explode(F.array_distinct(found)).alias("gram"))


def candidates(rows: DataFrame, queries: dict[str, list[set[str]]]) -> DataFrame:
    """(may_id, rules array<string>): by intersected postings, the rules that may match a document."""
    sets = postings(rows, sorted(set().union(*(s for q in queries.values() for s in q)))).groupBy("id").agg(F.collect_set("gram").alias("grams"))

    def holds(query: list[set[str]]) -> Column:
        return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.array_contains("grams", g) for g in sorted(s))) for s in query))

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return sets.select(F.col("id").alias("may_id"), kinds.alias("rules")).where(F.size("rules") > 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array<long> that starts from 0: by blocks of about the root of its length, then inside each.

    An array of m entries is copied for about the root of m steps, so that work grows with m to the power 1.5.
    """
    zero = F.lit(0).cast("long")

    def extend(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(step(F.element_at(acc, -1), x)))

    def inside(v: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(v) - 1, wide), lambda at: F.slice(v, at + 1, wide))
        return _let(blocks, lambda b: _let(F.aggregate(F.transform(b, lambda x: F.aggregate(x, zero, step)), F.array(zero), extend), lambda before: whole(b, before)))

    def whole(blocks: Column, before: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda x, i: F.slice(F.aggregate(x, F.array(F.get(before, i)), extend), F.lit(2), F.size(x))))

    return _let(values, lambda v: F.when(F.size(v) > 0, inside(v)).otherwise(v))


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of the rule's leftmost non-overlapping matches that are long enough."""
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x).cast("long"))
    found = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    value = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else found
    between = lengths(F.split(text, rule.pattern, -1))

    def placed(m: Column) -> Column:
        ends = _running(F.zip_with(m, F.slice(between, F.lit(1), F.size(m)), lambda x, y: x + y), lambda a, x: a + x)
        each = F.arrays_zip(m.alias("m"), value.alias("v"), ends.alias("end"))
        fit = F.filter(each, lambda x: x["v"] >= rule.at_least)
        return F.transform(fit, lambda x: F.struct((x["end"] - x["m"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))

    return _let(found, placed).cast(SPANS)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep columns, text, spans array<struct<start,rank,kind,end>> by start, then rule order)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("rest"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r))}
    read = rows.withColumn("rules", F.array().cast("array<string>"))
    if queries:
        leads = F.lower("text").rlike(_any_of(sorted({_rarest(s) for q in queries.values() for s in q})))
        led = rows.where(leads)
        may = candidates(led, queries)
        met = led.join(may, F.col("id").eqNullSafe(F.col("may_id")), "left").select(*rows.columns, F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))
        read = met.union(read.where(~leads))
    lists = [
        F.when(F.array_contains("rules", r.kind) if r.kind in queries else F.col("text").rlike(r.pattern), _spans(r, k, F.col("text"))).otherwise(F.array().cast(SPANS)) for k, r in enumerate(rules)
    ]
    return read.select(F.col("id").alias(id_col), *[F.col("rest")[k].alias(k) for k in keep], "text", F.sort_array(F.concat(*lists)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans)."""
    found = find_secrets(docs, RULES, id_col, text_col)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select(id_col, *[count(r.kind) for r in BASE_RULES], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def mask_secrets(found: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """found with every span of text_col replaced; overlapping spans are replaced as one.

    The text is cut to blocks of BLOCK characters once; what lies between two spans is joined from the blocks that it touches,
    so that work grows with the text and its spans, and a text is held twice at most.
    """

    def between(blocks: Column, low: Column, high: Column) -> Column:
        first = F.floor(low / BLOCK).cast("int")
        touched = F.slice(blocks, first + 1, F.ceil(high / BLOCK).cast("int") - first)
        return F.when(high > low, F.substring(F.array_join(touched, ""), (low - first * BLOCK + 1).cast("int"), (high - low).cast("int"))).otherwise("")

    def masked(blocks: Column, reach: Column) -> Column:
        """reach: how far the spans up to each one go."""
        before = F.concat(F.array(F.lit(0).cast("long")), reach)
        pieces = F.zip_with("spans", F.slice(before, F.lit(1), F.size(reach)), lambda s, low: F.when(s["start"] >= low, F.concat(between(blocks, low, s["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), between(blocks, F.element_at(reach, -1), F.length(text_col).cast("long")))

    reach = _running(F.transform("spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    cut = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = _let(cut, lambda blocks: _let(reach, lambda r: masked(blocks, r)))
    return found.withColumn(text_col, F.when(F.size("spans") > 0, whole).otherwise(F.col(text_col)))


#: DuckDB SQL of secret_digests over documents.
def oracle() -> str:
    def part(rule: Rule) -> str:
        rank = [r.kind for r in RULES].index(rule.kind)
        pat = rule.pattern.replace("'", "''")
        return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pat}', 0)) + 1), lambda i: {{
          'start': list_sum(list_transform((regexp_split_to_array(t, '{pat}'))[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform((regexp_extract_all(t, '{pat}', 0))[1:i-1], lambda x: length(x))), 0),
          'rank': {rank}, 'kind': '{rule.kind}',
          'stop': list_sum(list_transform((regexp_split_to_array(t, '{pat}'))[1:i], lambda x: length(x))) + list_sum(list_transform((regexp_extract_all(t, '{pat}', 0))[1:i], lambda x: length(x))),
          'v': length((regexp_extract_all(t, '{pat}', {rule.group}))[i])}}), lambda s: s.v >= {rule.at_least})"""

    lists = ", ".join(f"CASE WHEN regexp_matches(t, '{r.pattern.replace(chr(39), chr(39) * 2)}') THEN {part(r)} ELSE [] END AS s_{r.kind}" for r in RULES)
    base = " || ".join(f"s_{r.kind}" for r in BASE_RULES)
    every = " || ".join(f"s_{r.kind}" for r in RULES)
    text = "coalesce(array_to_string(list_transform(list_sort({}), lambda s: s.kind || ':' || s.start::BIGINT || ':' || s.stop::BIGINT), ','), '')"
    return f"""WITH found AS (SELECT doc_id, {lists} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, len(s_assign)::BIGINT AS n_assign, len(s_access)::BIGINT AS n_access, len(s_hex)::BIGINT AS n_hex,
  sha256({text.format(base)}) AS base_sha256, {text.format(every)} AS spans FROM found"""

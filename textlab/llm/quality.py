"""Quality rules as a short-circuit cascade.

Each rule is a Spark expression that is true where a document fails. A bounded sample
gives every rule's cost (time a character) and selectivity (share of the documents left
that it rejects). Rules then run in the order of rejection per cost, each on those
documents alone that the earlier ones let pass: one CASE expression, whose branches Spark
evaluates lazily. Rules over words or lines that follow each other share the splitting. The
order changes the work, never the decision.

The rules are those of published web-text filters, with bounds that are loose enough for
short texts and for scripts without blanks.

``rejected_by`` names the first failing rule *as the rules are listed*, so that it doesn't
depend on measured times; it is evaluated for rejected documents only.

Defined results: a null text, or one of white space alone, fails ``no_words``. Texts are
judged whole, whatever their length. Repeated rows get equal results, an empty table gives
an empty one. Extra columns are ignored by ``judge`` and kept by ``keep_good``, also ones
named like its results.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the sample that costs and selectivities are estimated from.
SAMPLE_ROWS = 1000
#: Timed passes of each rule over the sample, of which the fastest counts.
PASSES = 2
BLANK = "[ \\t\\n\\r]+"


@dataclass(frozen=True)
class Rule:
    """``fails`` builds the expression from the text, its words or its lines (``over``); ``sql`` is the same for DuckDB, over ``text``, ``w`` or ``l``."""

    name: str
    fails: Callable[[Column], Column]
    sql: str
    over: str = "text"


def words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\r")), BLANK)


#: What rules look at; rules side by side in the cascade that look at the same share it.
VIEWS: dict[str, Callable[[Column], Column]] = {"words": words, "lines": lambda t: F.split(t, "\n")}


def rate(text: Column, pattern: str) -> Column:
    """Matches of a one-character pattern by characters."""
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def share(parts: Column, pattern: str) -> Column:
    """Share of the words or lines that match a pattern."""
    return F.size(F.filter(parts, lambda x: x.rlike(pattern))) / F.size(parts)


def repeats(w: Column) -> Column:
    """Share of the words that equal the word before them."""
    same = F.aggregate(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda n, x: n + x)
    return same / F.size(w)


def mean_length(w: Column) -> Column:
    """Mean length of the words of a text in ASCII; 0 for others, whose words may not be parted by blanks."""
    joined = F.array_join(w, "")
    return F.when(F.length(joined) == F.octet_length(joined), F.length(joined) / F.size(w)).otherwise(0.0)


def _sql_rate(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}')) / greatest(length(text), 1)"


def _sql_share(parts: str, pattern: str) -> str:
    return f"len(list_filter({parts}, lambda x: regexp_matches(x, '{pattern}'))) / len({parts})"


_BULLET = "^[ \\t]*[-*•‣◦]"


def dotted(lines: Column) -> Column:
    """Share of the lines that end with an ellipsis."""

    def ends(line: Column) -> Column:
        line = F.rtrim(line, F.lit(" \t\r"))
        return F.endswith(line, F.lit("...")) | F.endswith(line, F.lit("…"))

    return F.size(F.filter(lines, ends)) / F.size(lines)


RULES = [
    Rule("no_words", lambda t: ~t.rlike("[^ \\t\\n\\r]"), "not regexp_matches(text, '[^ \\t\\n\\r]')"),
    Rule("symbols", lambda t: rate(t, "[#$%&*|~^]") > 0.035, _sql_rate("[#$%&*|~^]") + " > 0.035"),
    Rule("brackets", lambda t: rate(t, "[{}<>\\[\\]]") > 0.1, _sql_rate("[{}<>\\[\\]]") + " > 0.1"),
    Rule("upper_case", lambda t: (F.length(t) >= 20) & (rate(t, "\\p{Lu}") > 0.35), "length(text) >= 20 and " + _sql_rate("\\p{Lu}") + " > 0.35"),
    Rule("digits", lambda t: (F.length(t) >= 200) & (rate(t, "[0-9]") > 0.3), "length(text) >= 200 and " + _sql_rate("[0-9]") + " > 0.3"),
    Rule(
        "repeated_words",
        lambda w: (F.size(w) >= 5) & (repeats(w) > 0.2),
        "len(w) >= 5 and len(list_filter(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] = p[2])) / len(w) > 0.2",
        "words",
    ),
    Rule("few_different_words", lambda w: (F.size(w) >= 100) & (F.size(F.array_distinct(w)) * 10 < F.least(F.size(w), F.lit(2000))), "len(w) >= 100 and len(list_distinct(w)) * 10 < least(len(w), 2000)", "words"),
    Rule("few_words_with_letters", lambda w: (F.size(w) >= 50) & (share(w, "\\p{L}") < 0.55), "len(w) >= 50 and " + _sql_share("w", "\\p{L}") + " < 0.55", "words"),
    Rule("long_words", lambda w: (F.size(w) >= 20) & (mean_length(w) > 20), "len(w) >= 20 and strlen(array_to_string(w, '')) = length(array_to_string(w, '')) and length(array_to_string(w, '')) / len(w) > 20", "words"),
    Rule("duplicate_lines", lambda l: (F.size(l) >= 5) & (1 - F.size(F.array_distinct(l)) / F.size(l) > 0.5), "len(l) >= 5 and 1 - len(list_distinct(l)) / len(l) > 0.5", "lines"),
    Rule("bullets", lambda l: (F.size(l) >= 5) & (share(l, _BULLET) > 0.9), "len(l) >= 5 and " + _sql_share("l", _BULLET) + " > 0.9", "lines"),
    Rule("ellipses", lambda l: (F.size(l) >= 5) & (dotted(l) > 0.3), "len(l) >= 5 and len(list_filter(l, lambda x: suffix(rtrim(x, chr(32) || chr(9) || chr(13)), '...') or suffix(rtrim(x, chr(32) || chr(9) || chr(13)), '…'))) / len(l) > 0.3", "lines"),
]


def verdict(text: Column, rules: list[Rule], name: Callable[[Rule], Column], otherwise: Column) -> Column:
    """The name of the first of some rules that fails, lazily; neighbours with the same view share it."""
    if not rules:
        return otherwise
    over = rules[0].over
    n = next((i for i, r in enumerate(rules) if r.over != over), len(rules))
    rest = verdict(text, rules[n:], name, otherwise)

    def branches(view: Column) -> Column:
        out = None
        for r in rules[:n]:
            out = F.when(r.fails(view), name(r)) if out is None else out.when(r.fails(view), name(r))
        return out.otherwise(rest)

    if over == "text":
        return branches(text)
    return F.get(F.transform(F.array(VIEWS[over](text)), branches), F.lit(0))  # the view is bound once


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    rejected: float


def sample_texts(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """At most ``rows`` texts, spread over the whole table."""
    n = docs.count()
    picked = docs.select(docs[text_col].alias("text"))
    if n > rows:
        picked = picked.sample(min(1.0, 1.2 * rows / n), seed=11).limit(rows)
    return [r.text or "" for r in picked.collect()]


def estimate(spark: SparkSession, texts: list[str], rules: list[Rule] = RULES) -> list[Estimate]:
    """Rules in the order of rejection per cost, by a greedy choice over the sample.

    The cost of a rule is the time of a pass over the sample less that of a pass without a
    rule. At each place of the order the rule comes next that rejects the most of what is
    left for its cost. Without a sample the rules keep the order in which they are listed.
    """
    if not texts:
        return [Estimate(r.name, 0.0, 0.0) for r in rules]
    chars = max(1, sum(map(len, texts)))
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1).persist()
    try:
        table.count()

        def failed(rule: Rule) -> Column:
            return verdict(F.col("text"), [rule], lambda _: F.lit(True), F.lit(False))

        def timed(column: Column) -> float:
            best = float("inf")
            for _ in range(PASSES):
                start = time.perf_counter()
                table.agg(F.sum(column)).collect()
                best = min(best, time.perf_counter() - start)
            return best

        base = timed(F.length("text"))
        cost = {r.name: max(timed(failed(r).cast("int")) - base, 1e-4) / chars for r in rules}
        fails = table.select(*[failed(r).alias(r.name) for r in rules]).collect()
    finally:
        table.unpersist()
    left, order, rest, over = fails, [], [r.name for r in rules], {r.name: r.over for r in rules}
    while rest:
        share = {n: sum(row[n] for row in left) / max(1, len(left)) for n in rest}
        view = over[order[-1].name] if order else "text"  # of equals one that can share the last one's view
        name = max(rest, key=lambda n: (share[n] / cost[n], over[n] == view != "text", -cost[n]))
        order.append(Estimate(name, cost[name], share[name]))
        rest.remove(name)
        left = [row for row in left if not row[name]]
    return order


def failing(text: Column, order: list[str] | None = None, rules: list[Rule] = RULES) -> tuple[Column, Column]:
    """(rejected, rejected_by) of a text; ``order`` is that of the cascade."""
    by = {r.name: r for r in rules}
    body = F.coalesce(text, F.lit(""))
    rejected = verdict(body, [by[n] for n in order or list(by)], lambda _: F.lit(True), F.lit(False))
    return rejected, verdict(body, rules, lambda r: F.lit(r.name), F.lit(None).cast("string"))


def cascade(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> list[str]:
    """Names of the rules in the order that suits these documents."""
    return [e.name for e in estimate(docs.sparkSession, sample_texts(docs, text_col), rules)]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, keep, rejected_by) of every document; ``rejected_by`` is null for those kept."""
    rejected, named = failing(F.col("text"), cascade(docs, text_col, rules), rules)
    first = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).select("doc_id", "text", rejected.alias("rejected"))
    return first.select("doc_id", (~F.col("rejected")).alias("keep"), F.when(F.col("rejected"), named).alias("rejected_by"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all of their columns."""
    rejected, _ = failing(docs[text_col], cascade(docs, text_col, rules), rules)
    return docs.where(~rejected)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document is kept, and by which rule it is rejected."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = (
    "with t as (select doc_id, coalesce(text, '') as text from documents), "
    "v as (select doc_id, text, string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' '), ' ') as w, string_split(text, chr(10)) as l from t), "
    "r as (select doc_id, case " + " ".join(f"when {r.sql} then '{r.name}'" for r in RULES) + " end as rejected_by from v) "
    "select doc_id, rejected_by is null as keep, rejected_by from r"
)

"""Quality rules as a short-circuit cascade.

A rule is a predicate that rejects a text. The time that one evaluation of each rule takes is measured on a small
sample, as is which sampled texts it rejects; each next rule is the one with the most rejections per cost among the
sampled texts that the rules before it have left. Every rule runs only on texts that no rule before it has rejected. The
base rule comes first, as its counts are results of their own, and so does what else the counts decide for next to
nothing. The order changes the time and never the verdict, so a sample is enough for it.

Nulls and odd inputs: a null or empty text has no words, so it fails the base rule; words and lines are taken of whole
texts of any length; rules that tie in rejections per cost run in the order given; equal rows get equal results; an empty
table gives an empty result; columns of the input that have the name of a result are replaced, all others are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modeloom.llm.frames import head, let, plain_text, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Seconds by which two runs of one job differ; what costs less counts as if it cost this.
NOISE = 0.02


class Facts(NamedTuple):
    """What rules can ask about a text without working it out again."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_lines: Column
    n_dup_lines: Column


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], Column]


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))


def _count(pattern: str) -> Callable[[Facts], Column]:
    return lambda f: F.regexp_count(f.text, F.lit(pattern))


def _lines_like(pattern: str, tenths: int) -> Callable[[Facts], Column]:
    return lambda f: F.size(F.filter(lines_with_words(f.text), lambda x: x.rlike(pattern))) * 10 > tenths * f.n_lines


#: Patterns of lines that begin with a list mark, and that end with an ellipsis; both engines read them.
LIST_MARK, ELLIPSIS = r"^[ \x09-\x0D]*[-*•]", r"(?:\.\.\.|…)[ \x09-\x0D]*\z"

RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda f: f.n_symbols * 10 > f.n_words),
    Rule("exclamations", lambda f: _count("!")(f) * 10 > f.n_words),
    Rule("capitals", lambda f: _count("[A-Z]")(f) * 100 > 30 * _count("[A-Za-z]")(f)),
    Rule("long_words", lambda f: F.char_length(f.text) > 15 * f.n_words),
    Rule("short_words", lambda f: f.word_chars < 2 * f.n_words),
    Rule("few_letters", lambda f: _count("\\p{L}")(f) * 2 < f.word_chars),
    Rule("repeated_lines", lambda f: f.n_dup_lines * 2 > f.n_lines),
    Rule("list_marks", _lines_like(LIST_MARK, 9)),
    Rule("ellipses", _lines_like(ELLIPSIS, 3)),
)


def repeated_words(words: Column, n: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of `size` words that the text has twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))

        def union(s: Column) -> Column:
            steps = F.transform(s, lambda a, k: F.least(F.lit(size), F.coalesce(F.get(s, k + 1) - a, F.lit(size))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

        return let(let(ordered, starts), union)

    def windows(h: Column) -> Column:
        all_of = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(h, i, size)))
        return let(all_of, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))

    return F.when(n > size, let(hashes, windows)).otherwise(F.lit(0).cast("long"))


def facts(docs: DataFrame, text: str, rest: Sequence[Column]) -> DataFrame:
    """`rest` and the counts of each text; n_lines under a name of its own."""
    own, body = "__qr_words", plain_text(F.col(text))
    n = F.size(own)
    return docs.select(*rest, words_of(F.col(text)).alias(own), let(lines_with_words(body), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("__qr_lines")).select(
        *rest,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(own, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.col("__qr_lines.n").alias("__qr_n_lines"),
        F.col("__qr_lines.dup").cast("long").alias("n_dup_lines"),
        repeated_words(F.col(own), n).alias("n_repeat_words"),
    )


def facts_of(text: Column) -> Facts:
    return Facts(text, *(F.col(c) for c in ("n_words", "word_chars", "n_symbols", "__qr_n_lines", "n_dup_lines")))


def measured(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 256, repeats: int = 32) -> tuple[list[float], list[tuple[bool, ...]]]:
    """Seconds that one evaluation of each rule takes, and of each sampled text which rules reject it. The sample is the first
    `sample_rows` rows that Spark finds, of each the first 16,384 characters. A job evaluates a rule `repeats` times on every
    text, in one task; what the same job takes without a rule is taken off, so the cost is the rule's own."""
    sample = facts(head(docs.select(plain_text(F.col(text)).alias("t")), sample_rows, "t", 1 << 14), "t", [F.col("t")]).coalesce(1).cache()
    try:
        verdicts = [tuple(map(bool, r)) for r in sample.select(*[rule.rejects(facts_of(F.col("t"))).alias(f"r{k}") for k, rule in enumerate(rules)]).collect()]
        often = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("__qr_time"))

        def seconds(condition: Column) -> float:
            took = []
            for _ in range(2):
                began = time.perf_counter()
                often.agg(F.count_if(condition)).collect()
                took.append(time.perf_counter() - began)
            return min(took)

        empty = seconds(F.col("__qr_time") < 0)
        return [max(seconds(rule.rejects(facts_of(F.col("t")))) - empty, NOISE) / (repeats * max(1, len(verdicts))) for rule in rules], verdicts
    finally:
        sample.unpersist()


def by_rejections(costs: Sequence[float], verdicts: Sequence[tuple[bool, ...]]) -> list[int]:
    """Each next rule has the most rejections per cost among texts that the rules before it have left."""
    order, open_, left = [], list(range(len(costs))), list(verdicts)
    while open_:
        best = max(open_, key=lambda k: (sum(v[k] for v in left) + 0.5) / (len(left) + 1) / costs[k])
        order.append(best)
        open_.remove(best)
        left = [v for v in left if not v[best]]
    return order


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 256) -> list[Rule]:
    """The rules in the order in which they run."""
    return [rules[k] for k in by_rejections(*measured(docs, rules, text, sample_rows))]


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 256) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    order = cascade(docs, rules, text, sample_rows)
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    rejected = F.when(F.col("base_failed"), True)
    for rule in order:
        rejected = rejected.when(rule.rejects(facts_of(plain_text(F.col(text)))), True)
    return facts(docs, text, rest).withColumn("base_failed", base).withColumn("kept", ~rejected.otherwise(False)).drop("__qr_n_lines")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM rep) GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n, count(*) AS lines,
    count(*) FILTER (regexp_matches(l, '""" + LIST_MARK + r"""')) AS marked, count(*) FILTER (regexp_matches(l, '""" + ELLIPSIS + r"""')) AS dotted
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, length(t) AS chars,
    coalesce(lines, 0) AS lines, coalesce(marked, 0) AS marked, coalesce(dotted, 0) AS dotted, len(regexp_extract_all(t, '\p{L}')) AS all_letters,
    len(regexp_extract_all(t, '!')) AS marks, len(regexp_extract_all(t, '[A-Z]')) AS capitals, len(regexp_extract_all(t, '[A-Za-z]')) AS letters
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR marks * 10 > n_words OR capitals * 100 > 30 * letters OR chars > 15 * n_words
    OR word_chars < 2 * n_words OR all_letters * 2 < word_chars OR n_dup_lines * 2 > lines OR marked * 10 > 9 * lines OR dotted * 10 > 3 * lines) AS kept
FROM b
"""

"""Quality rules, line dedup and URL filters: against SQL, and on odd tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from modeloom.llm import line_dedup, quality_rules, url_filters
from modeloom.llm.queries import ORACLES, QUERIES
from tests.llm import odd
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    check(spark, data, QUERIES[name], ORACLES[name])


def base(t):
    w = odd.words(t)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if odd.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again)


def test_quality_rules_by_definition(spark):
    repeated = " ".join(["one two three four five six seven eight nine ten"] * 6)
    docs = odd.docs(spark, [(200, repeated), (201, "$$$ " * 30 + repeated), (202, "The cat sat on the mat again. " * 9)])
    out = quality_rules.apply_rules(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()
    for r in out.collect():
        n, chars, symbols, dup, again = base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, again)
        assert r["base_failed"] == (n < 20 or 100 * again > 30 * n) and not (r["base_failed"] and r["kept"])
    assert quality_rules.apply_rules(odd.empty(spark)).count() == 0


def test_order_of_rules_does_not_matter(spark):
    docs = odd.docs(spark, [(200, "$$ abc def " * 40), (201, "ABC DEF GHI " * 30), (202, "wow! " * 40)])
    a, b = (quality_rules.apply_rules(docs, rules).select("doc_id", "kept").collect() for rules in (quality_rules.RULES, quality_rules.RULES[::-1]))
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_cascade_puts_rejections_per_cost_first(spark):
    heavy = quality_rules.Rule("never", lambda f: F.length(f.text) < 0)
    light = quality_rules.Rule("always", lambda f: F.length(f.text) >= 0)
    order = quality_rules.cascade(odd.docs(spark), [heavy, light])
    assert [r.name for r in order] == ["always", "never"]


def test_order_by_rejections_that_are_left():
    both, first, third = (True, True, False), (True, False, False), (False, False, True)
    assert quality_rules.by_rejections([1.0, 1.0, 1.0], [both] * 5 + [first] + [third] * 2) == [0, 2, 1]
    assert quality_rules.by_rejections([9.0, 1.0, 1.0], [both] * 5 + [first] + [third] * 2) == [1, 2, 0]


def test_costs_are_the_rules_own(spark):
    dear = quality_rules.Rule("dear", lambda f: F.regexp_count(f.text, F.lit("[a-p]+ [b-z]+ [0-9]")) > 10**6)
    cheap = quality_rules.Rule("cheap", lambda f: f.n_words < 0)
    (a, b), verdicts = quality_rules.measured(odd.docs(spark), [dear, cheap])
    assert a > 5 * b and not any(map(any, verdicts))


def test_each_rule_rejects_its_own_kind(spark):
    plain = " ".join(["The quick brown fox jumps over lazy dogs and runs away from all of them"] + [f"word{i}" for i in range(30)])
    kinds = {
        "symbols": plain + " #$%& <|>" * 2, "exclamations": plain + " yes!!!!!!!", "capitals": " ".join("ABCDEFGH"[i % 8] * 5 + str(i) for i in range(40)), "long_words": " ".join(f"{i}" + "x" * 30 for i in range(40)),
        "short_words": " ".join(chr(97 + i % 26) + ("a" if i % 9 == 0 else "") for i in range(60)), "few_letters": " ".join(f"{i * 7919}" for i in range(60)),
        "repeated_lines": "\n".join([f"line with some words {i}" for i in range(10)] + ["same line"] * 14), "list_marks": "\n".join(f"- item number {i} of many" for i in range(20)), "ellipses": "\n".join(f"read more about thing {i} here..." for i in range(20)),
    }
    for rule in quality_rules.RULES:
        docs = spark.createDataFrame([(0, plain), (1, kinds[rule.name])], "doc_id long, text string")
        rows = quality_rules.facts(docs, "text", [F.col("doc_id"), F.col("text")]).select("doc_id", rule.rejects(quality_rules.facts_of(F.col("text"))).alias("no")).collect()
        assert {r["doc_id"]: r["no"] for r in rows} == {0: False, 1: True}, rule.name


def brute_lines(rows, least):
    """What stays of each text: for every two places, runs of equal lines of so many words go where they stand later."""
    texts = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    units = [[(i, x, len(odd.words(x))) for i, x in enumerate(t.split("\n")) if odd.words(x)] for _, _, t in texts]
    gone = [set() for _ in texts]
    for p, one in enumerate(units):
        for q, two in enumerate(units[: p + 1]):
            for shift in range(1 if p == q else -len(two), len(one)):
                run = []
                for i in range(max(0, shift), len(one) + 1):
                    if i < len(one) and i - shift < len(two) and one[i][1] == two[i - shift][1]:
                        run.append(one[i])
                        continue
                    if sum(u[2] for u in run) >= least:
                        gone[p] |= {u[0] for u in run}
                    run = []
    return {key: "\n".join(x for i, x in enumerate(key[2].split("\n")) if i not in gone[p]) for p, key in enumerate(texts)}


def test_lines_against_all_pairs_of_places(spark):
    rng = random.Random(21)
    lines = [" ".join(f"w{i}x{j}" for j in range(rng.choice([1, 4, 9, 15, 30]))) for i in range(40)]
    rows = [(rng.choice([None, *range(1, 30)]), None)]
    for d in range(40):
        own = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(40)
            own += rng.choice([lines[a : a + rng.randint(1, 9)], [f"own {d} {rng.random()}"], ["", " "], [lines[0]] * 12])
        rows.append((d // 2, "\n".join(own)))
    rows += rows[3:6]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.dedup_lines(docs, min_words=20, counts=True).collect()
    assert len(found) == len(rows)
    order = [(i, t) for i, (_, t) in enumerate(rows)]
    again = line_dedup.dedup_lines(spark.createDataFrame(order, "doc_id long, text string"), min_words=20).collect()
    assert {r["doc_id"]: r["text"] or "" for r in again} == {k[1]: t for k, t in brute_lines(order, 20).items()}
    assert sum(r["n_removed"] for r in found) > 50


def few_kinds_of_lines(n, seed=5):
    """Texts of a few kinds of lines over and over, so each fingerprint stands at many places with other neighbours."""
    rng = random.Random(seed)
    kinds = [" ".join(f"w{i}x{j}" for j in range(1 + 3 * i)) for i in range(5)]
    return [(d, "\n".join(rng.choices(kinds, k=rng.randint(3, 14)))) for d in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_rounds_of_extension_do_not_matter(spark, rounds):
    rows = [*few_kinds_of_lines(40), (40, "\n".join(["again and again"] * 30))]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=20, rounds=rounds).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {k[1]: t for k, t in brute_lines(rows, 20).items()}


def test_runs_come_from_extension(spark, monkeypatch):
    words = lambda a, b: "\n".join(" ".join(f"l{i}w{j}" for j in range(10)) for i in range(a, b))
    docs = spark.createDataFrame([(0, words(0, 12)), (1, "own line\n" + words(2, 10) + "\nanother")], "doc_id long, text string")
    hashed = line_dedup.line_hashes(docs)
    runs = {(r["key"]["id"], r["a"], r["e"]) for r in line_dedup.repeated_runs(hashed, rounds=1).collect()}
    assert min(a for _, a, _ in runs) == 1 and max(e for _, _, e in runs) == 9 and {i for i, _, _ in runs} == {1}
    assert line_dedup.fingerprints(hashed).count() < 20, "windows share their least lines"
    monkeypatch.setattr(line_dedup, "alike", lambda one, two: F.lit(0))
    assert not line_dedup.repeated_runs(hashed, rounds=1).count()


def test_line_dedup_by_definition(spark):
    rng_lines = [f"line {i} " + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(8)]
    run = "\n".join(rng_lines[:4])
    extra = [(300, run), (301, "start here\n" + run + "\n\nend here"), (302, rng_lines[0] + "\n" + rng_lines[1]), (303, run + "\n" + run), (304, "\n".join(rng_lines[4:6])), (305, "\n".join(rng_lines[5:7]))]
    docs = odd.docs(spark, extra)
    out = line_dedup.dedup_lines(docs, min_words=50, counts=True)
    assert out.count() == docs.count()
    found = {}
    for r in out.collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert found[300][0]["n_removed"] == 0 and found[300][0]["text"] == run
    assert found[301][0]["text"] == "start here\n\nend here" and found[301][0]["n_removed"] == 4
    assert found[302][0]["text"] == rng_lines[0] + "\n" + rng_lines[1], "a run of 44 words is too short"
    assert found[303][0]["text"] == "" and found[303][0]["n_removed"] == 8
    assert found[304][0]["n_removed"] == found[305][0]["n_removed"] == 0
    assert len(found[0]) == 4 and sorted(r["n_removed"] for r in found[0]) == [0, 0, 0, 0], "equal rows are one document"
    assert found[107][0]["n_removed"] > 0 and found[107][0]["text"] == ""
    assert found[100][0]["text"] is None
    assert line_dedup.dedup_lines(odd.empty(spark)).count() == 0


def test_url_intervals_and_keys(spark):
    entries = spark.createDataFrame(
        [("domain", "Bad.Example", "2024-01-10", "add"), ("domain", "bad.example", "2024-02-10", "remove"), ("domain", "bad.example", "2024-01-20", "add"), ("host", "h.example", "2024-01-01", "add"), ("host", "h.example", "2024-01-01", "remove"),
         ("prefix", "site.example/a/b", "2024-01-01", "add"), ("host", None, "2024-01-01", "add"), ("host", "H6.example", "2024-01-01", "add"), ("host", "[2001:db8::1]", "2024-01-01", "add"), ("prefix", "Deep.example/" + "s/" * 40, "2024-01-01", "add")], "kind string, value string, since string, action string",
    )
    cases = [
        ("http://sub.bad.example/x", "2024-01-09", False), ("http://sub.bad.example/x", "2024-01-10", True), ("http://BAD.example:80/x?y", "2024-02-09", True), ("http://bad.example", "2024-02-10", False),
        ("http://notbad.example/", "2024-01-15", False), ("https://h.example/", "2024-01-05", False), ("https://site.example/a/b/c", "2024-03-01", True), ("https://site.example/a/bc", "2024-03-01", False),
        ("https://user@site.example/a/b#f", "2024-03-01", True), ("https://site.example/A/b", "2024-03-01", False), ("https://u:p@x@site.example/a//b/?q", "2024-03-01", True),
        ("http://h6.example./", "2024-01-05", True), ("//h6.example/p", "2024-01-05", True), ("http://[2001:DB8::1]:8080/x", "2024-01-05", True), ("http://[2001:db8::2]/x", "2024-01-05", False), ("http://deep.example/" + "s/" * 40 + "t", "2024-01-05", True),
        ("http://deep.example/" + "s/" * 39 + "t", "2024-01-05", False), (None, "2024-01-15", False), ("no url", "2024-01-15", False), ("http://bad.example/", None, False), ("", "2024-01-15", False), ("http://" + "a." * 50 + "bad.example/", "2024-01-15", True),
    ]
    captures = spark.createDataFrame([(i, u, d, "x", "y") for i, (u, d, _) in enumerate(cases + cases)], "i int, url string, fetched_on string, key string, blocked string")
    out = url_filters.filter_urls(captures, entries)
    assert out.count() == 2 * len(cases)
    for r in out.collect():
        assert r["blocked"] == cases[r["i"] % len(cases)][2], (r["url"], r["fetched_on"])
    assert not url_filters.filter_urls(captures, entries.limit(0)).filter("blocked").count()
    assert url_filters.filter_urls(captures.limit(0), entries).count() == 0

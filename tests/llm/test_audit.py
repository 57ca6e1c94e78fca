"""Filter audit, against a walk through every order by definition and its SQL, and on odd tables."""

import collections
import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from modeloom.llm import filter_audit
from modeloom.llm.queries import ORACLES, QUERIES
from tests.llm import odd
from tests.oracle import check


def brute(rows, labels):
    """rows (doc_id, text, lang); labels (doc_id, quality, toxic)."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    judged = []
    for d, t, lang in rows:
        t, w = t or "", odd.words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        judged.append((lang or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out, shapley = {}, collections.Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in judged}:
            left = [x for x in judged if x[0] == part]
            gone = []
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left = [x for x in left if f not in x[1]]
                gone += removed
                shapley[part, f] += len(removed)
                only = sum(x[1] == {f} for x in judged if x[0] == part)
                out[part, order, k + 1] = [len(left), len(removed), redundant, only, sum(x[2] for x in removed), sum(x[3] for x in removed)]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def tables(spark):
    extra = [(200 + i, odd.text(random.Random(i % 3), 240) + (" #" if i % 2 else ""), "en") for i in range(6)]
    extra += [(300, "WORD " * 250, None), (301, odd.text(random.Random(9), 230), "")]
    docs = odd.docs(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    labels = [(0, 1, 0), (0, 0, 1), (103, 1, None), (103, None, None), (None, 1, 1), (202, 0, 1), (5, 1, 1), (107, 1, 0), (999, 1, 1)]
    return docs.withColumn("label", F.lit(1)).withColumn("mask", F.lit("m")).withColumn("words", F.lit("w")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))


def test_audit_by_definition(spark):
    docs, labels = tables(spark)
    found = filter_audit.audit(docs, labels).collect()
    expected = brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r)[:3] for r in labels.collect()])
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found} == expected
    assert len(found) == len(expected) == 600 * 3


def test_many_parts_and_empty_tables(spark):
    docs, labels = tables(spark)
    spread = docs.withColumn("lang", F.concat("lang", F.col("doc_id") % 7))
    expected = brute([tuple(r) for r in spread.select("doc_id", "text", "lang").collect()], [tuple(r)[:3] for r in labels.collect()])
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(spread, labels, most_parts=2).collect()} == expected
    assert filter_audit.audit(odd.empty(spark), labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}


def test_fields_of_counters():
    wide = filter_audit.wide_counters()
    most = (1 << 63) - 1
    total = most * wide[0]
    assert filter_audit.unpacked(filter_audit.packed(total)) == total, "counts as large as a long's neither overflow nor spill into other fields"
    assert int.from_bytes(filter_audit.outcomes(0b0000011).tobytes(), "little") == wide[0b0000011]


def test_audit_sql(spark, data):
    assert check(spark, data, QUERIES["op11_filter_audit"], ORACLES["op11_filter_audit"]) >= 600

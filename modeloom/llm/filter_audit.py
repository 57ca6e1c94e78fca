"""Filter interaction audit: what each of five filters takes away in every order they can stand in.

A document's failed filters, with whether it is labelled good and toxic, are a mask of seven bits. `wide_counters` maps each
mask to one big integer whose 64-bit fields hold the outcomes of all 600 steps (120 orders of five filters): kept after the
step, removed by it, failing but removed earlier, removed though good, removed and toxic; and five more fields for
documents that fail one filter only. Tasks add up the integers of their documents for each part, the sums are added up by
salted parts and then by part, and the fields of a part's sum are unpacked. A field counts documents, so 64 bits don't
overflow: Spark itself counts rows in a signed long.

The filters: A under 200 words; B 100 * distinct words < 50 * words; C 100 * capitals A-Z > 3 * code points; D any of
`#$%&*|`; E the same text as a row with a smaller id. Equal texts have equal masks, so before E is decided rows are counted
by text and part on the map side, and no text or hot group of copies meets in a task.

Nulls and odd inputs: a null text is an empty one; a null lang is the part ''; a null id has no label, isn't smaller than any
and fails no E; repeated rows count as often as they occur, and have E only by an id that is smaller still; an id with
several labels is good or toxic if one of them says so, labels that are null say nothing; texts of any length are worked
on whole; other columns, whatever their names, are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm.frames import cut, let, plain_text, words_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, k) for order in ORDERS for k in range(len(FILTERS))]
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
#: Fields of a counter, outcome by outcome, then one for each filter.
N_FIELDS = len(OUTCOMES) * len(STEPS) + len(FILTERS)
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
#: Parts that a task has counters of at a time, and salts of a part's counters.
MOST_PARTS, SALTS = 256, 32


def outcomes(mask: int) -> np.ndarray:
    """The fields of one document."""
    fields = np.zeros(N_FIELDS, "<u8")
    of = {name: fields[i * len(STEPS) : (i + 1) * len(STEPS)] for i, name in enumerate(OUTCOMES)}
    fails = {f for i, f in enumerate(FILTERS) if mask >> i & 1}
    for at, (order, k) in enumerate(STEPS):
        earlier = bool(fails & set(order[:k]))
        fails_here = order[k] in fails
        of["kept"][at] = not earlier and not fails_here
        of["removed"][at] = not earlier and fails_here
        of["redundant"][at] = earlier and fails_here
        of["good_lost"][at] = of["removed"][at] and bool(mask & GOOD)
        of["toxic_lost"][at] = of["removed"][at] and bool(mask & TOXIC)
    if len(fails) == 1:
        fields[len(OUTCOMES) * len(STEPS) + FILTERS.index(*fails)] = 1
    return fields


def wide_counters() -> list[int]:
    """The big integer of each mask."""
    return [int.from_bytes(outcomes(mask).tobytes(), "little") for mask in range(4 * GOOD)]


def packed(total: int) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(total.to_bytes(8 * N_FIELDS, "little"))


def unpacked(blob: bytes) -> int:
    return int.from_bytes(zstandard.ZstdDecompressor().decompress(blob), "little")


def _sums(totals: dict[str, int], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": list(totals), "salt": [salt] * len(totals), "total": [packed(x) for x in totals.values()]}, SUMS_ARROW)


SUMS = "part string, salt int, total binary"
SUMS_ARROW = pa.schema([("part", pa.string()), ("salt", pa.int32()), ("total", pa.binary())])


def add_counters(most_parts: int):
    """Sums of counters by part over the rows (part, mask, n) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, salt, totals = wide_counters(), TaskContext.get().partitionId() % SALTS, defaultdict(int)
        for batch in batches:
            for part, mask, n in zip(*(batch.column(c).to_pylist() for c in ("part", "mask", "n")), strict=True):
                totals[part] += n * wide[mask]
                if len(totals) > most_parts:
                    yield _sums(totals, salt)
                    totals.clear()
        yield _sums(totals, salt)

    return run


def merge_counters(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the sums of a part, one batch in memory at a time."""
    total = sum(unpacked(x) for batch in rows for x in batch.column("total").to_pylist())
    yield _sums({key[0].as_py(): total}, 0)


def unpack_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 600 rows of each part."""
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("total").to_pylist(), strict=True):
            fields = np.frombuffer(unpacked(blob).to_bytes(8 * N_FIELDS, "little"), "<u8").astype(np.int64)
            found = dict(zip(OUTCOMES, fields[: -len(FILTERS)].reshape(len(OUTCOMES), -1), strict=True))
            letter = np.array([FILTERS.index(order[k]) for order, k in STEPS])
            shapley = np.zeros(len(FILTERS), np.int64)
            np.add.at(shapley, letter, found["removed"])
            yield pa.RecordBatch.from_pydict({
                "part": [part] * len(STEPS), "filter_order": [order for order, _ in STEPS], "step": pa.array([k + 1 for _, k in STEPS], pa.int32()),
                "kept": found["kept"], "removed": found["removed"], "redundant": found["redundant"], "unique_fails": fields[-len(FILTERS) :][letter],
                "good_lost": found["good_lost"], "toxic_lost": found["toxic_lost"], "shapley": shapley[letter],
            })


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """doc_id, part, a digest of the text, and the mask of A to D; one narrow row a document."""
    body = plain_text(F.col(f"`{text}`"))
    count = lambda words: F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))
    own = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"),
        let(words_of(F.col(f"`{text}`")), count).alias("words"), F.char_length(body).alias("points"), F.regexp_count(body, F.lit("[A-Z]")).alias("capitals"), body.rlike("[#$%&*|]").alias("marked"),
    )
    fails = (F.col("words.n") < 200, 100 * F.col("words.distinct") < 50 * F.col("words.n"), 100 * F.col("capitals").cast("long") > 3 * F.col("points").cast("long"), F.col("marked"))
    return own.select("doc_id", "part", "digest", sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0)).alias("mask"))


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n): n documents of a text and part have the mask, E and the labels included."""
    rows = cut(text_failures(docs, doc_id, text, part).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("copies")))
    said = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("toxic"))
    label = (F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("label")
    own = rows.filter("doc_id IS NOT NULL").join(said.filter("labelled IS NOT NULL"), F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "part", "digest", "mask", "copies", label)
    known = own.unionByName(rows.filter("doc_id IS NULL").withColumn("label", F.lit(0)))
    # Of one text, part and label ids differ, so the copies of the least id are those of one row here.
    texts = known.groupBy("digest", "part", "mask", "label").agg(
        F.sum("copies").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("copies", "doc_id"), F.lit(0)).alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("copies")).otherwise(0)).alias("without_id")
    )
    firsts = texts.groupBy("digest").agg(F.min("least").alias("first"))
    first = texts.join(firsts, "digest")
    passing = F.col("without_id") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    each = F.explode(F.array(F.struct((F.col("mask") + F.col("label")).alias("mask"), passing.alias("n")), F.struct((F.col("mask") + F.col("label") + F.lit(1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - passing).alias("n"))))
    return first.select("part", each.alias("x")).select("part", "x.mask", "x.n").filter("n > 0")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", most_parts: int = MOST_PARTS) -> DataFrame:
    """One row for each part, order of the filters and step, with counts of documents of the part."""
    sums = masks(docs, labels, doc_id, text, part).mapInArrow(add_counters(most_parts), SUMS)
    merged = sums.groupBy("part", "salt").applyInArrow(merge_counters, SUMS).groupBy("part").applyInArrow(merge_counters, SUMS)
    return merged.mapInArrow(unpack_fields, AUDIT)


#: The same counts by definition, from masks counted by part.
ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT t.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false) AS e
  FROM texts t LEFT JOIN said USING (doc_id)
),
masks AS (SELECT part, good, toxic, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (SELECT o, k, substr(o, k, 1) AS l, string_split(left(o, k - 1), '') AS before FROM orders, range(1, 6) r(k)),
seen AS (
  SELECT part, o, k, l, n, good, toxic, fails[l] AS here, len(list_filter(before, lambda x: x <> '' AND fails[x])) > 0 AS earlier,
    fails[l] AND len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) = 1 AS only_here
  FROM masks, steps
),
counted AS (
  SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, l, sum(CASE WHEN NOT earlier AND NOT here THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT earlier AND here THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN earlier AND here THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN only_here THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT earlier AND here AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT earlier AND here AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM counted
"""

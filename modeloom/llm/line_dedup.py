"""Line deduplication by winnowing over line hashes.

The units are lines with a word. A line starts a window: itself and as many following lines as it takes to reach
`min_words` words. The least of a window's line hashes is its fingerprint, so two places that share a run of that many
words have a fingerprint at the same line of it. Documents are known by these few lines alone: a fingerprint carries the
hashes of its neighbours, as many on each side as reach `min_words` words, which is as far as a run has to be followed
before the next window has a fingerprint of its own.

Places with the same fingerprint are a class. Each is paired with the first of its class (by doc_id, then by place in the
text), and the match is extended line by line to both sides; a match of `min_words` words is a repeated run, whose lines are
deleted in the later place. A place that goes on otherwise than the first may go on like another one: it joins the class of
those that leave the first at the same line, before or after, and with the same next line. In the class by a line after, what
goes beyond the first's match before is left out, as the class by a line before has it. So every match that is longer than the
one with the first is found in a later round; classes of one place end. What `ROUNDS` rounds don't settle (texts of one line
over and over) is compared by the content of the windows around its fingerprints, within its class.

No step gathers a group: a class meets in a minimum and a count first, then in a join whose other side has one short row a
class; the first places of the largest classes are broadcast, so their members stay where they are.

Nulls and odd inputs: a null or empty text has no line and stays as it is; a null doc_id sorts first; rows with equal
doc_id and text are one document, so they don't delete each other's lines and get equal results; lines without a word
are neither counted nor deleted; a text of any length is taken whole, and one line that repeats thousands of times in it
costs a fingerprint a line; ties between places are broken by the text's hash; an empty table gives an empty result;
other columns are kept, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.llm.frames import cut, join_uneven, let, plain_text, row_key

MIN_WORDS = 50
#: Rounds of extension; classes that are still left are settled by windows. Results are the same at any number.
ROUNDS = 4
#: Of so many classes at most the first places are broadcast; one has at most 2 * MIN_WORDS hashes.
MOST_HOT = 4096
_WORD = "[^ \\t\\n\\x0B\\f\\r]"


def _lines(text: Column) -> Column:
    return F.split(plain_text(text), "\n")


def _reach(words: Column, least: Column | int) -> Column:
    """How many of these it takes to reach `least`; 0 if they don't."""
    step = lambda state, x: F.struct((state["words"] + F.when(state["words"] < least, x).otherwise(0)).alias("words"), (state["n"] + (state["words"] < least).cast("int")).alias("n"))
    return F.aggregate(words, F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), step, lambda s: F.when(s["words"] >= least, s["n"]).otherwise(F.lit(0)))


def _least_at(hashes: Column) -> Column:
    return F.array_position(hashes, F.array_min(hashes)).cast("int") - 1


def line_hashes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document with lines: key, and of its lines with a word the hashes h, the numbers of words w and the places at."""
    units = F.filter(F.transform(_lines(F.col(text)), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda u: u["x"].rlike(_WORD))
    cut_up = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), units.alias("u"))
    each = lambda f: F.transform("u", f)
    hashed = cut_up.select("key", each(lambda u: F.xxhash64(u["x"])).alias("h"), each(lambda u: F.regexp_count(u["x"], F.lit(_WORD + "+"))).alias("w"), each(lambda u: u["i"]).alias("at"))
    return hashed.filter(F.size("h") > 0).dropDuplicates(["key"])


def _chained(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans a to e (not included) that overlap or touch become one."""
    order = Window.partitionBy(*by).orderBy("a", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("apart", F.coalesce(F.col("a") > before, F.lit(True)).cast("int")).withColumn("chain", F.sum("apart").over(order))
    return marked.groupBy(*by, "chain").agg(F.min("a").alias("a"), F.max("e").alias("e")).drop("chain")


def fingerprints(hashed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line that is the least of some window: key, place, print (its hash), words, and the hashes and words of
    its neighbours before and after, nearest first, as many as it takes to reach `min_words` words."""
    ahead = lambda w, i: F.when(F.get(w, i) >= min_words, F.lit(1)).otherwise(_reach(F.slice(w, i + 1, min_words), min_words))
    least = lambda h, w, i: let(ahead(w, i), lambda n: F.when(n > 0, i + _least_at(F.slice(h, i + 1, n))))
    places = let(F.col("h"), lambda h: let(F.col("w"), lambda w: F.array_distinct(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: least(h, w, i))))))
    chosen = hashed.select("key", "h", "w", places.alias("places")).filter(F.size("places") > 0)
    chosen = chosen.select("key", "h", "w", F.explode("places").alias("place"))
    at, most = F.col("place"), F.lit(min_words)
    before = lambda x: F.reverse(F.slice(F.col(x), F.greatest(at - most + 1, F.lit(1)), F.least(at, most)))
    after = lambda x: F.slice(F.col(x), at + 2, most)
    found = chosen.select("key", "place", F.get("h", at).alias("print"), F.get("w", at).alias("words"), *[side(x).alias(f"{x}_{name}") for x in "hw" for name, side in (("before", before), ("after", after))])

    def near(name: str) -> Column:
        few = let(_reach(F.col(f"w_{name}"), min_words), lambda n: F.when(n > 0, n).otherwise(F.size(f"w_{name}")))
        return let(few, lambda n: F.struct(F.slice(f"h_{name}", F.lit(1), n).alias("h"), F.slice(f"w_{name}", F.lit(1), n).alias("w"))).alias(name)

    return found.select("key", "place", "print", "words", near("before"), near("after"))


def _sum(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, b: a + b)


def alike(one: Column, two: Column) -> Column:
    """How many values two arrays have in common before they differ."""
    return (F.array_position(F.concat(F.zip_with(one, two, lambda x, y: F.coalesce(x == y, F.lit(False))), F.array(F.lit(False))), False) - 1).cast("int")


def _extended(members: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """One round over classes of places: runs with each class's first place, and the members of the next classes."""
    first = F.struct("key", "place", "print", F.col("before.h").alias("before"), F.col("after.h").alias("after"))
    firsts = cut(members.groupBy("class").agg(F.min(first).alias("first"), F.count("*").alias("weight")).filter("weight > 1"))
    total = firsts.agg(F.sum("weight")).first()[0] or 0
    met = join_uneven(members, firsts, "class", total, MOST_HOT).filter("struct(key, place) > struct(first.key, first.place) AND print = first.print")
    met = met.withColumn("left", alike(F.col("before.h"), F.col("first.before"))).withColumn("right", alike(F.col("after.h"), F.col("first.after")))
    met = cut(met.drop("first", "weight"))
    shared = F.col("words") + _sum(F.slice("before.w", F.lit(1), F.col("left"))) + _sum(F.slice("after.w", F.lit(1), F.col("right")))
    runs = met.filter(shared >= min_words).select("key", (F.col("place") - F.col("left")).alias("a"), (F.col("place") + F.col("right") + 1).alias("e"))
    own = ["key", "place", "print", "words"]
    further = lambda side, n: F.xxhash64("class", F.lit(side), n, F.get(F.col(f"{side}.h"), F.col(n)))
    clipped = F.struct(F.slice("before.h", F.lit(1), F.col("left")).alias("h"), F.slice("before.w", F.lit(1), F.col("left")).alias("w"))
    more_before = met.filter(F.size("before.h") > F.col("left")).select(further("before", "left").alias("class"), *own, "before", "after")
    more_after = met.filter(F.size("after.h") > F.col("right")).select(further("after", "right").alias("class"), *own, clipped.alias("before"), "after")
    return runs, more_before.unionByName(more_after).filter(F.col("words") + _sum(F.col("before.w")) + _sum(F.col("after.w")) >= min_words)


def _by_window(members: DataFrame, min_words: int) -> DataFrame:
    """Runs of classes that are left after the last round, by the content of the windows that a place is the least of."""
    lines = lambda x, own: F.concat(F.reverse(F.col(f"before.{x}")), F.array(own), F.col(f"after.{x}"))
    rows = members.select("class", "key", "place", F.size("before.h").alias("n"), lines("h", "print").alias("h"), lines("w", "words").alias("w"))

    def lengths(s: Column) -> Column:
        """Of the windows that begin at s: the one that just reaches `min_words`, and those that would not without line s."""
        tail = F.slice("w", s + 2, min_words)
        longest = let(_reach(tail, min_words), lambda m: F.when(m > 0, m).otherwise(F.size(tail) + 1))
        chosen = lambda n: (n > 0) & (s + _least_at(F.slice("h", s + 1, F.greatest(n, F.lit(1)))) == F.col("n"))
        return let(_reach(F.slice("w", s + 1, min_words), min_words), lambda n: F.when(chosen(n), F.sequence(n, F.greatest(n, longest))).otherwise(F.array().cast("array<int>")))

    windows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("s")).select("*", F.explode(lengths(F.col("s"))).alias("long"))
    start = F.struct("key", "a")
    windows = cut(windows.select("class", "key", (F.col("place") - F.col("n") + F.col("s")).alias("a"), "long", F.xxhash64(F.slice("h", F.col("s") + 1, F.col("long")), "long").alias("content")))
    first = windows.groupBy("class", "content").agg(F.min(start).alias("first"), F.max(start).alias("last")).filter("first < last").select("class", "content", "first")
    return windows.join(first, ["class", "content"]).filter(start > F.col("first")).select("key", "a", (F.col("a") + F.col("long")).alias("e"))


def repeated_runs(hashed: DataFrame, min_words: int = MIN_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """Runs that stand earlier: key, lines a to e (not included) of its lines with a word. They may overlap."""
    places = cut(fingerprints(hashed, min_words))
    place = F.struct("key", "place")
    shared = places.groupBy("print").agg(F.min(place).alias("one"), F.max(place).alias("two")).filter("one < two").select("print")
    members, found = cut(places.join(shared, "print").withColumn("class", F.col("print"))), []
    for _ in range(rounds):
        if members.isEmpty():
            break
        runs, following = _extended(members, min_words)
        found.append(runs)
        several = following.groupBy("class").agg(F.count("*").alias("rows")).filter("rows > 1").select("class")
        members = cut(following.join(several, "class"))
    return functools.reduce(DataFrame.unionByName, [*found, _by_window(members, min_words)])


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """A row (key, gone) for each document that loses lines; gone: their places among the lines of the text, from 0."""
    hashed = cut(line_hashes(docs, text, doc_id))
    spans = _chained(repeated_runs(hashed, min_words, rounds), ["key"])
    lost = spans.groupBy(F.col("key").alias("lost")).agg(F.flatten(F.collect_list(F.sequence("a", F.col("e") - 1))).alias("lines"))
    return lost.join(hashed, F.col("lost").eqNullSafe(F.col("key"))).select("key", let(F.col("at"), lambda at: F.transform("lines", lambda i: F.get(at, i))).alias("gone"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, counts: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """`docs` without the repeated lines; with `counts`, also n_lines (those with a word) and n_removed."""
    gone = repeated_lines(docs, text, doc_id, min_words, rounds)
    key, other, at, body = "__ld_key", "__ld_other", "__ld_gone", F.col(text)
    keyed = docs.withColumn(key, row_key(F.col(doc_id), body))
    joined = keyed.join(gone.select(F.col("key").alias(other), F.col("gone").alias(at)), F.col(key).eqNullSafe(F.col(other)), "left")
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    left = let(_lines(body), lambda lines: F.array_join(F.transform(places(lines), lambda i: F.get(lines, i)), "\n"))
    new = F.when(F.col(at).isNull(), body).otherwise(left)
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    if counts:
        columns += [F.size(F.filter(_lines(body), lambda x: x.rlike(_WORD))).cast("long").alias("n_lines"), F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*columns)


#: What stays of each text, by comparing whole windows of lines; every line of a run of 50 words begins or ends one within it.
ORACLE_TEXTS = r"""
l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM {docs}),
l AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS upto
  FROM (SELECT *, len(regexp_extract_all(l, '[^ 	-
]+')) AS n FROM l0) WHERE n > 0
),
w AS (
  SELECT a.doc_id, a.r AS s, min(b.r) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.r >= a.r AND b.r < a.r + 50 AND b.upto >= a.upto - a.n + 50
  GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.r) AS s, b.r AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.r <= b.r AND a.r > b.r - 50 AND b.upto - a.upto + a.n >= 50
  GROUP BY b.doc_id, b.r
),
c AS (SELECT w.doc_id, w.s, w.e, string_agg(l.l, chr(10) ORDER BY l.r) AS body FROM w JOIN l ON l.doc_id = w.doc_id AND l.r BETWEEN w.s AND w.e GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS copy FROM c),
gone AS (SELECT DISTINCT l.doc_id, l.p FROM x JOIN l ON l.doc_id = x.doc_id AND l.r BETWEEN x.s AND x.e WHERE copy > 1),
cleaned AS (
  SELECT l0.doc_id, string_agg(l0.l, chr(10) ORDER BY l0.p) FILTER (gone.p IS NULL) AS text, count(gone.p) AS n_removed,
    count(*) FILTER (regexp_matches(l0.l, '[^ 	-
]')) AS n_lines
  FROM l0 LEFT JOIN gone ON gone.doc_id = l0.doc_id AND gone.p = l0.p GROUP BY l0.doc_id
)"""

ORACLE = "WITH " + ORACLE_TEXTS.format(docs="documents") + " SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM cleaned"

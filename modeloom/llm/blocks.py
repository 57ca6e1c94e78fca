"""Corpus-wide counts for blocks of documents.

Documents are dealt to blocks of some megabytes by a hash. A block asks for each of its distinct 64-bit keys once: the
keys of a block, split into shards by their leading bits, travel as one packed array a shard. A shard adds up what all
blocks have of a key and answers each block in the order of its question. So a key costs at most one entry a block,
however often it occurs, and neither a block nor a shard grows with the corpus: their numbers do.

Rows that are equal in all columns are one row of a block, with the number of its copies, where there are many of them;
they are counted before they are dealt, so a row that a third of the table repeats is one row of one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from modeloom.llm.frames import cut, parts
from modeloom.llm.grams import U, pack, unpack

#: Of the stored bytes of the tables read; text is about twice as long.
BLOCK_BYTES = 4 << 20
#: A row is counted before it is dealt out if more than this many are equal to it, and more than 1 of `MOST_HOT` of all.
COPIES = 64
#: So at most so many keys of counted rows are broadcast, whatever the table.
MOST_HOT = 1 << 20
ASKED = "kind int, shard long, block long, keys binary, counts binary"
ANSWERED = "kind int, shard long, block long, totals binary"


def in_blocks(docs: DataFrame, doc_id: str, text: str, block_bytes: int = BLOCK_BYTES, copies: int = COPIES) -> tuple[DataFrame, int]:
    """`docs` with columns `block`, dealt out by it, and `copies`, the number of equal rows that a row stands for; and the
    number of blocks."""
    n = parts(docs, block_bytes)
    keyed = docs.withColumn("row_hash", F.xxhash64(doc_id, text))
    dealt = lambda rows: rows.withColumn("block", F.pmod("row_hash", F.lit(n))).drop("row_hash").repartition(n, "block")
    counts = keyed.groupBy("row_hash").agg(F.count("*").alias("rows")).filter(F.col("rows") > copies)
    hot = cut(counts.filter(F.col("rows") * MOST_HOT > docs.count()).select("row_hash"))
    if hot.isEmpty():
        return dealt(keyed.withColumn("copies", F.lit(1).cast("long"))), n
    single = keyed.join(F.broadcast(hot), "row_hash", "left_anti").withColumn("copies", F.lit(1).cast("long"))
    counted = keyed.join(F.broadcast(hot), "row_hash", "left_semi").groupBy("row_hash", *docs.columns).agg(F.count("*").alias("copies"))
    return dealt(single.unionByName(counted)), n


def each_copy(found: DataFrame) -> DataFrame:
    """A result with a column `copies`, with each row as often as it says, and without the column."""
    columns = [c for c in found.columns if c != "copies"]
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*columns)


def shard_bits(n_blocks: int) -> int:
    """Of the leading bits that tell a key's shard: as many shards as blocks, so neither grows with the corpus."""
    return max(1, n_blocks - 1).bit_length()


def by_shard(questions: DataFrame, n_blocks: int) -> GroupedData:
    """Grouped by kind and shard, over as many tasks as there are blocks whatever the questions' size once packed."""
    return questions.repartition(n_blocks, "kind", "shard").groupBy("kind", "shard")


def question(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> dict:
    """Columns of ASKED; keys are distinct and rise."""
    shard = (keys >> U(64 - bits)).astype(np.int64)
    present = np.unique(shard)
    low, high = np.searchsorted(shard, present), np.searchsorted(shard, present, "right")
    return {
        "kind": [kind] * len(present), "shard": present.tolist(), "block": [block] * len(present),
        "keys": [pack(keys[a:b], rising=True) for a, b in zip(low, high, strict=True)],
        "counts": [pack(counts[a:b]) for a, b in zip(low, high, strict=True)],
    }


ASKED_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERED_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("totals", pa.binary())])


def asked(questions: list[dict]) -> pa.Table:
    return pa.concat_tables([pa.table(x, schema=ASKED_ARROW) for x in questions]) if questions else ASKED_ARROW.empty_table()


def shard_totals(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """Of a shard: distinct keys, totals, the row that had a key first, each row's keys, the blocks of the rows."""
    rows = rows.sort_by("block")
    each = [unpack(x.as_py(), rising=True) for x in rows["keys"]]
    all_keys = np.concatenate(each)
    counts = np.concatenate([unpack(x.as_py()) for x in rows["counts"]])
    order = np.argsort(all_keys, kind="stable")
    ordered = all_keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])[order[first]]
    return ordered[first], np.add.reduceat(counts[order], first), owner, each, rows["block"].to_pylist()


def answers(kind: int, shard: int, keys: np.ndarray, totals: np.ndarray, owner: np.ndarray, each: list[np.ndarray], blocks: list[int]) -> pa.Table:
    """To each block, in the order of its keys: twice the total, and one more if it is the first block to have the key."""
    found = {"kind": [kind] * len(each), "shard": [shard] * len(each), "block": blocks, "totals": []}
    for row, own in enumerate(each):
        at = np.searchsorted(keys, own)
        found["totals"].append(pack(totals[at] * U(2) + (owner[at] == row).astype(np.uint64)))
    return pa.table(found, schema=ANSWERED_ARROW)


def answered(rows: pa.Table, kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For a block's keys of a kind: totals, and whether the block is the first to have a key."""
    own = sorted(((x["shard"], x["totals"]) for x in rows.to_pylist() if x["kind"] == kind), key=lambda x: x[0])
    values = np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for _, x in own)])
    if len(values) != n:
        raise RuntimeError(f"a block asked for {n} keys of kind {kind} and got {len(values)} answers")
    return values >> U(1), (values & U(1)).astype(bool)

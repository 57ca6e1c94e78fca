"""Cross-tokenizer alignment: against the libraries and a walk over offsets, and on odd tables."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from modeloom.llm import token_alignment as ta
from tests.llm import odd


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(ta.DEFAULT_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.DEFAULT_B)


def spelled(libraries, text):
    """Tokens (id, bytes) of both sides, by the libraries alone."""
    a, b = libraries
    alphabet = ta.byte_alphabet()
    left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return left, right


def brute(libraries, rows):
    docs, links = [], collections.Counter()
    for d, t in rows:
        left, right = spelled(libraries, t) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            docs.append((d, 0, 0, [], []))
            continue
        ends = [{}, {}]
        for side, tokens in enumerate((left, right)):
            at = 0
            for k, (_, x) in enumerate(tokens):
                at += len(x)
                ends[side][at] = k
        groups, own, i, j = [], [], 0, 0
        for at in sorted(ends[0].keys() & ends[1].keys()):
            k, m = ends[0][at] + 1, ends[1][at] + 1
            groups.append(",".join(str(x) for x, _ in left[i:k]) + "|" + ",".join(str(x) for x, _ in right[j:m]))
            own.append((left[k - 1][0], right[m - 1][0]))
            i, j = k, m
        links.update(own)
        docs.append((d, len(left), len(right), groups, own))
    best = collections.defaultdict(int)
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    return collections.Counter(
        (d, n_a, n_b, len(groups), len(own), sum(links[x] == best[x[1]] for x in own), sum(links[x] for x in own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for d, n_a, n_b, groups, own in docs
    )


STRANGE = ["<|endoftext|> <s> </s> <0x41> plain", "  two  spaces \t\n\n tabs ", "日本語のテキスト 한국어 العربية עברית", "naïve café ÀÉÎ ﬁ ½ ², Ångström", "a▁b", "🙂🙃 \U0001f468‍\U0001f469 x", " 　 wide", "é combining", "\x00\x01\x7f", " " * 5000 + "x", "don't I'll we've 12345 3.14 ###", "x" * 3000]


def test_alignment_by_definition(spark, libraries, data):
    extra = [(400 + i, t) for i, t in enumerate(STRANGE)]
    docs = odd.docs(spark, extra).withColumn("ids", F.lit(1)).withColumn("pairs", F.lit(2)).withColumn("n_a", F.lit(3))
    some = spark.read.parquet(f"{data}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    docs = docs.unionByName(some, allowMissingColumns=True).repartition(3, "doc_id")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = ta.align(docs).collect()
    assert found[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, found)) == brute(libraries, rows)


def test_empty_table_and_texts_without_tokens(spark):
    assert ta.align(odd.empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (None, "a▁b")], "doc_id long, text string")
    assert {tuple(r) for r in ta.align(none).collect()} == {(d, 0, 0, 0, 0, 0, 0, "") for d in (1, 2, None)}


def test_identity_and_fast_encoder(libraries):
    v = ta.Vocabularies.load(ta.DEFAULT_A, ta.DEFAULT_B)
    identity, e = v.identity(), ta.Encoders(v)
    assert all(b < 0 or v.a_bytes[a] == v.b_bytes[b] for a, b in enumerate(identity))
    known = {x for x in v.b_bytes if x is not None}
    assert all((identity[a] >= 0) == (x in known) for a, x in enumerate(v.a_bytes) if x is not None)
    rng = random.Random(4)
    texts = STRANGE + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x2000, 0x3100), 32, 10])) for _ in range(80)) for _ in range(300)]
    assert [e.encode_a(" " + t) for t in texts] == [x.ids for x in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_regular_links_and_pairs_share_no_pair(libraries):
    v = ta.Vocabularies.load(ta.DEFAULT_A, ta.DEFAULT_B)
    e = ta.Encoders(v)
    for t in STRANGE:
        if ids := e.encode(t):
            g = ta.Groups.of(e, *ids)
            a, b = g.links()
            assert not (set(zip(a[g.regular], b[g.regular], strict=True)) & set(zip(a[~g.regular], b[~g.regular], strict=True)))
            assert (np.array([v.b_bytes[i] for i in b[g.regular]], object) == np.array([v.a_bytes[i] for i in a[g.regular]], object)).all()

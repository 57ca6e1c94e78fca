"""The pipeline's stages one by one and together."""

import corpus_pipeline
from modeloom.llm import jaccard_join
from modeloom.llm.queries import QUERIES
from tests.llm import odd
from tests.llm.test_search import brute_join


def test_stages_in_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, data))
        rows = docs.count()
        assert 0 < rows <= before, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "n-gram Jaccard join":
            left = [tuple(r) for r in docs.select("doc_id", "text").collect()]
            assert all(links == 0 for _, _, links in brute_join(left))
        before = rows
    assert docs.filter("size(piece_ids) = 0 AND length(text) > 0").count() == 0
    assert corpus_pipeline.run(spark, data).count() == before


def test_stages_live_with_odd_tables(spark, data):
    """Of each text of 20 words or more, but for one that repeats a line 3,000 times, the row with the least id stays, a null one if
    there is no other; a copy under another id has lost its lines by then, which stand in the first."""
    least = {}
    for d, t in (tuple(r) for r in odd.docs(spark).select("doc_id", "text").collect()):
        if len(odd.words(t)) >= 20 and d != 108:
            least[t] = d if least.get(t) is None else least[t] if d is None else min(d, least[t])
    for frame, wanted in ((odd.docs(spark), least | {"": 107}), (odd.empty(spark), {})):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut(stage(spark, docs, data))
        found = docs.select("doc_id", "text").collect()
        assert {r["text"]: r["doc_id"] for r in found} == wanted and len(found) == len(wanted)


def test_lines_of_whole_runs_go(spark, data):
    run = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate((7, 25, 25, 3, 2))]
    alone = [[" ".join(f"{k}y{i}x{j}" for j in range(30)) for i in range(3)] for k in range(2)]
    texts = ["\n".join([*alone[0], *run, alone[0][0] + " a"]), "\n".join([alone[1][0], *run, "", *alone[1][1:]]), "\n".join(run[2:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, data).collect()}
    assert left == {0: texts[0], 1: "\n".join([alone[1][0], "", *alone[1][1:]]), 2: texts[2]}


def test_encoded_texts_are_decoded(spark, data):
    rows = corpus_pipeline.encoding(spark, odd.docs(spark), data).select("text", "decoded").collect()
    assert rows and all(r["decoded"] == r["text"] for r in rows)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [round(jaccard_join.SIMILARITY, 1), jaccard_join.WORDS] == [0.8, 5]

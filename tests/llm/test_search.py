"""Jaccard join, decontamination, language ID and pieces: against brute force, and on odd tables."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from modeloom.llm import components, decontaminate, grams, jaccard_join, language_id, pieces
from tests.llm import odd


def brute_join(rows, similarity=0.8):
    """Of each row its class (the least id) and how many other rows are similar."""
    sets = []
    for _, t in rows:
        w = odd.words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else ("short", tuple(w)))
    links, root = collections.Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            both = x == y or isinstance(x, frozenset) and isinstance(y, frozenset) and len(x & y) >= similarity * len(x | y) - 1e-9
            if both:
                links[a] += 1
                links[b] += 1
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    classes = collections.defaultdict(list)
    for a in range(len(rows)):
        classes[find(a)].append(rows[a][0])
    least = lambda ids: None if None in ids else min(ids)
    return collections.Counter((rows[a][0], least(classes[find(a)]), links[a]) for a in range(len(rows)))


def near_copies(seed, groups, each, n=150, edits=3):
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = odd.text(rng, n).split()
        for k in range(each):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            out.append((1000 + g * each + k, " ".join(own)))
    return out


@pytest.mark.parametrize("leaf, depth", [(2048, 4), (8, 4), (5, 0)])
def test_join_by_definition(spark, leaf, depth):
    docs = odd.docs(spark, near_copies(1, 6, 12))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = jaccard_join.join_similar(docs, leaf=leaf, depth=depth).collect()
    assert collections.Counter(tuple(r) for r in found) == brute_join(rows)
    assert jaccard_join.join_similar(odd.empty(spark)).count() == 0


def test_texts_that_differ_in_one_long_word_are_no_copies(spark):
    docs = spark.createDataFrame([(i, f"a b {odd.thue_morse(1024, bool(i))} c d") for i in (0, 1)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.join_similar(docs).collect()) == [(0, 0, 0), (1, 1, 0)]


def test_one_of_each_group_stays(spark):
    docs = odd.docs(spark, near_copies(2, 3, 5))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    left = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    assert set(brute_join(left)) == {(d, d, 0) for d, _ in left}, "what stays isn't similar"
    assert {c for _, c, _ in brute_join(rows)} == {d for d, _ in left}


def test_runs_reach_the_recall():
    for splits in (0, 1, 4):
        n, met = jaccard_join.runs(0.8, 1 - 1e-6, splits), 0.8 * 0.96**splits
        assert (1 - met) ** n <= 1e-6 < (1 - met) ** (n - 1)


def test_pairs_at_the_threshold_meet_below_deep_splits(spark):
    """Pairs of sets at a similarity of 0.8 among many that share a bucket, so that paths are split to the end."""
    rng = np.random.default_rng(22)
    tokens = rng.integers(1, 1 << 62, (600, jaccard_join.COORDINATES))
    tokens[:, :20] = np.where(rng.random((600, 20)) < 0.9, 7, tokens[:, :20])
    tokens[:, 20:] = np.where(rng.random((600, 44)) < 0.6, 7, tokens[:, 20:])
    twins = np.where(rng.random((600, jaccard_join.COORDINATES)) < 0.8, tokens, rng.integers(1, 1 << 62, tokens.shape))
    rows = [(k * 1000 + i, 10, [int(x) for x in own[i]]) for k, own in enumerate((tokens, twins)) for i in range(600)]
    sets = spark.createDataFrame(rows, "shingle_set long, size long, tokens array<long>")
    found = collections.defaultdict(set)
    for r in jaccard_join.leaves(sets, leaf=40).collect():
        found[r["leaf"]].add(r["shingle_set"])
    assert sum({i, 1000 + i} <= x for i in range(600) for x in [set().union(*[y for y in found.values() if i in y])]) == 600


def test_splits_of_sets_that_are_alike_make_no_more_pairs(spark):
    """Sets that share most tokens share a bucket whatever it is split on; among others that splits do tell apart."""
    rng = np.random.default_rng(24)
    tokens = np.where(rng.random((400, jaccard_join.COORDINATES)) < 0.95, 7, rng.integers(1, 1 << 62, (400, jaccard_join.COORDINATES)))
    sets = spark.createDataFrame([(i, 10, [int(x) for x in own]) for i, own in enumerate(tokens)], "shingle_set long, size long, tokens array<long>")
    found = collections.Counter(r["leaf"] for r in jaccard_join.leaves(sets, leaf=40).collect())
    assert sum(n * n for n in found.values()) < 3 * jaccard_join.runs(0.8, jaccard_join.RECALL) * 400**2


def test_a_chain_of_texts_that_look_alike_has_no_links(spark):
    rng = random.Random(23)
    parts = [odd.text(rng, 30) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(parts[j % 60] for j in range(i, i + 6))) for i in range(60)] + [(100, " ".join([*parts[0:6], "end"]))], "doc_id long, text string")
    found = {tuple(r) for r in jaccard_join.join_similar(docs, similarity=0.8).collect()}
    assert found == {(i, i, 0) for i in range(1, 60)} | {(0, 0, 1), (100, 0, 1)}


def test_overlaps_by_definition():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (5, 80, 120, 300, 1)]
    both = jaccard_join.overlaps(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(5) for j in range(5) if i != j)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    names = list(range(300))
    rng.shuffle(names)
    frame = spark.createDataFrame([(names[a], names[b]) for a, b in edges + edges[:5]], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(frame).collect()}
    for part in (range(41), range(100, 130), range(200, 209)):
        own = [names[i] for i in part]
        assert {found[x] for x in own} == {min(own)}
    assert components.components(frame.limit(0)).count() == 0


def items(seed=7, n=12):
    rng = random.Random(seed)
    return [(i, odd.text(rng, rng.choice([12, 20, 30, 50]))) for i in range(n)]


def test_leaks_and_paraphrases_are_found(spark):
    rng, bench = random.Random(8), items()
    hidden, clean = [], [(5000 + i, odd.text(rng, 300)) for i in range(40)]
    for i, t in bench:
        w = t.split()
        changed = [x if k % 6 != 3 else "changed" for k, x in enumerate(w)]
        for k, own in enumerate((w, [x.upper() + "," for x in w], changed)):
            hidden.append((100 * (i + 1) + 10_000 + k, odd.text(rng, rng.randint(0, 200)) + " " + " ".join(own) + ". " + odd.text(rng, rng.randint(0, 200))))
    docs = spark.createDataFrame(clean + hidden, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    wanted = {(100 * (i + 1) + 10_000 + k, i) for i, _ in bench for k in range(3)}
    assert len(wanted - found) <= 1 and not {d for d, _ in found} & {d for d, _ in clean}, (wanted - found, found - wanted)


def test_decontamination_on_odd_tables(spark):
    bench = spark.createDataFrame([*items(), (90, None), (91, ""), (92, "two words"), (0, items()[0][1])], "item_id long, text string")
    docs = odd.docs(spark, [(600, items()[3][1])])
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 1 and left.filter("doc_id = 600").count() == 0
    assert decontaminate.matches(odd.empty(spark), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_latent_vectors_cover_documents_beyond_the_first(spark):
    rng = random.Random(13)
    first, late = odd.text(rng, 60), [odd.text(rng, 2000), odd.text(rng, 60)]
    docs = spark.createDataFrame([(first,)] * 2100 + [(late[0],)] + [(late[1],)] * 20, "text string")
    space = decontaminate.fit(docs, spark.createDataFrame(items(), "item_id long, text string"), "text")
    for own in (first, late[0], late[0][9000:], late[1]):
        data = np.frombuffer(own.encode(), np.uint8)
        terms = decontaminate.term(decontaminate.plain_words(data, np.array([0, len(data)]))[0]) & (decontaminate.FOLDED - 1)
        assert (np.abs(space.vectors[terms]).max(axis=1) > 0).mean() > 0.99


def rows_by_definition(words, at, idf):
    begin, end = decontaminate._passages(words, at, *decontaminate.SCALES[1])
    a = np.zeros((len(begin), decontaminate.FOLDED))
    for row, (b, e) in enumerate(zip(begin, end, strict=True)):
        t = decontaminate.term(words[b:e])
        np.add.at(a[row], t & (decontaminate.FOLDED - 1), idf[t])
        a[row] /= np.sqrt((idf[t] ** 2).sum())
    return a


def test_sketch_of_the_passages_by_definition():
    rng = random.Random(14)
    texts = [odd.text(rng, n) for n in (1, 23, 24, 25, 47, 48, 49, 72, 73, 500)] + ["", None, "a a a"]
    idf = np.random.default_rng(1).uniform(0.5, 2, decontaminate.BUCKETS)
    words, at = decontaminate.plain_words(*decontaminate.buffers(pa.array(texts)))
    a = rows_by_definition(words, at, idf)
    rows = decontaminate.Rows.of(words, at, idf)
    assert len(rows.first) == len(a)
    draw = np.random.default_rng(2)
    signs, buckets, out = draw.choice([-1.0, 1.0], len(a)), draw.integers(0, decontaminate.SKETCH, len(a)), np.zeros(decontaminate.SKETCH * decontaminate.FOLDED, np.float32)
    rows.add(signs, buckets, out)
    wanted = np.zeros((decontaminate.SKETCH, decontaminate.FOLDED))
    np.add.at(wanted, buckets, signs[:, None] * a)
    assert np.allclose(out.reshape(wanted.shape), wanted, atol=1e-4)


def test_vectors_of_few_passages_are_their_singular_vectors(spark):
    """With fewer rows than the sketch has, and no two in one of its rows, nothing is lost."""
    docs = spark.createDataFrame([(odd.text(random.Random(16), 48),), (odd.text(random.Random(17), 48),)], "text string")
    space = decontaminate.fit(docs, spark.createDataFrame([], "text string"), "text", rank=2)
    words, at = decontaminate.plain_words(*decontaminate.buffers(pa.array([r["text"] for r in docs.collect()])))
    a = rows_by_definition(words, at, space.idf)
    back = a @ space.vectors.astype(float) @ space.vectors.T.astype(float)
    assert np.allclose(back, a, atol=1e-3)


def brute_matches(docs, bench):
    """Of all pairs of a document and an item: those with a stretch that has enough answer words and enough of the item in order."""
    df = collections.Counter(w for _, t in docs for w in set(t.lower().split()))
    out = set()
    for i, t in bench:
        item = t.lower().split()
        kinds = sorted(set(item), key=lambda w: df[w])
        edge = sorted(df[w] for w in kinds)[max(5, len(kinds) // 3) - 1]
        answer, wide = {w for w in kinds if df[w] <= edge}, int(1.5 * len(item)) + 2
        for d, text in docs:
            w = text.lower().replace(",", "").replace(".", "").split()
            for a in range(max(1, len(w) - wide + 1)):
                part = w[a : a + wide]
                if len(answer & set(part)) * 2 >= min(len(answer), max(5, len(kinds) // 3)):
                    number = {x: k for k, x in enumerate(set(part) | set(item))}
                    both = [np.array([number[x] for x in own], np.uint64) for own in (item, part)]
                    if decontaminate.longest_common(*both) >= 0.6 * len(item):
                        out.add((d, i))
                        break
    return out


def test_latent_search_finds_what_a_search_of_all_pairs_finds(spark):
    rng, bench = random.Random(18), items(19, 20)
    docs = [(i, odd.text(rng, 250)) for i in range(60)]
    for k in range(120):
        w = bench[k % 20][1].split()
        for _ in range(rng.randint(0, len(w) // 2)):
            j = rng.randrange(len(w))
            w[j : j + 1] = rng.choice([[], ["other"], [w[j], "more"]])
        docs.append((1000 + k, " ".join([odd.text(rng, rng.randint(1, 90)), *w, odd.text(rng, rng.randint(1, 90))])))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    wanted = brute_matches(docs, bench)
    assert len(wanted) > 80 and len(found & wanted) >= 0.9 * len(wanted) and len(found - wanted) <= 0.05 * len(wanted), (len(wanted), len(found & wanted), len(found - wanted))


def test_answers_of_the_benchmark_decide(spark):
    rng = random.Random(20)
    question = odd.text(rng, 30)
    docs = spark.createDataFrame([(1, question + " so paris it is"), (2, question + " so rome it is")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, question, "Paris")], "item_id long, text string, said string")
    assert [tuple(r)[:2] for r in decontaminate.matches(docs, bench, item_answer="said").collect()] == [(1, 5)]


def test_clean_documents_with_the_id_of_a_leak_stay(spark):
    rng, bench = random.Random(12), items()
    leak, clean = odd.text(rng, 90) + " " + bench[3][1], [odd.text(rng, 120) for _ in range(3)]
    for own in (None, 7):
        docs = spark.createDataFrame([(own, leak), (own, leak), *((own, t) for t in clean), (own, None), (8, clean[0])], "doc_id long, text string")
        left = decontaminate.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(own or 0, ""), *((own or 0, t) for t in clean), (8, clean[0])])


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 5)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in items()], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()} == {(i, i) for i, _ in items()}


def test_longest_common_subsequence_by_definition():
    rng = np.random.default_rng(9)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.longest_common(a, b) == t[-1, -1]


def test_plain_words():
    data, offsets = grams.buffers(pa.array(["The cat, the-CAT!", None, "É é"]))
    words, at = decontaminate.plain_words(data, offsets)
    assert at.tolist() == [0, 4, 4, 6] and words[0] == words[2] and words[1] == words[3] and words[4] == words[5] != words[0]


def test_language_id_on_held_out_text(spark):
    alphabets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "éèàçüö"}
    rng = random.Random(10)
    rows = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(rng.randint(5, 120))), lang) for i in range(240) for lang in [sorted(alphabets)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify(docs, F.col("doc_id") % 5 == 0).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) == 48 and np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in out)


def test_language_id_on_odd_tables(spark):
    docs = odd.docs(spark, [(700, "123 456 !!"), (701, "日本")])
    found = {}
    for r in language_id.identify(docs, F.lit(False)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == docs.count()
    assert all(found[d][0]["lang_pred"] == "und" and found[d][0]["score"] == 0 for d in (100, 101, 102, 700))
    assert found[701][0]["lang_pred"] in ("en", "fr")
    assert {r["lang_pred"] for r in language_id.identify(docs, F.lit(True)).collect()} == {"und"}
    assert language_id.identify(odd.empty(spark), F.lit(False)).count() == 0


def test_copies_of_one_text_do_not_hide_languages(spark):
    rng = random.Random(15)
    alphabets = {f"l{k}": "".join(chr(0x61 + (5 * k + j) % 26) for j in range(4)) for k in range(3)} | {f"x{k:02}": chr(0x400 + k) * 3 for k in range(70)}
    write = lambda lang: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(30))
    rows = [(0, write("l0"), "l0")] * 4000 + [(i, write(lang), lang) for i in range(100) for lang in ("l0", "l1", "l2")] + [(i, write(f"x{i:02}"), f"x{i:02}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    net = language_id.fit(docs, F.lit(True))
    assert net.langs == sorted(alphabets)
    out = language_id.identify(docs.filter("lang LIKE 'l%'"), F.lit(False)).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in out} == {"l0": 4100, "l1": 100, "l2": 100}


def test_every_window_counts():
    x, of = language_id.cut_windows(*grams.buffers(pa.array(["A" * 600, "", "É"])))
    assert of.tolist() == [0, 0, 0, 2] and bytes(x[0]) == b"a" * 256 and bytes(x[2]) == b"a" * 88 + b" " * 168 and bytes(x[3][:2]).decode() == "é"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.DEFAULT_MODEL)


def test_round_trip(vocabulary):
    codec = pieces.Codec(vocabulary)
    for t in ["", " ", "a", " a  b\n\tc ", "▁", "a▁b ▁", "日本語 🙂", "\x00\x7f", "x" * 500, "é" * 70, "The cat\r\nsat."]:
        assert codec.decode(codec.encode(t)) == t


def test_best_pieces_by_full_search(vocabulary):
    codec, score = pieces.Codec(vocabulary), dict(zip(vocabulary.pieces, vocabulary.scores, strict=True))
    for word in ["the", "hello", "transportation", "zqxj", "naïve", "ß"]:
        unit, best = pieces.MARK + word, [0.0]
        for end in range(1, len(unit) + 1):
            spelled = best[end - 1] + len(unit[end - 1].encode()) * codec.byte_score
            best.append(max([spelled, *(best[a] + score[unit[a:end]] for a in range(end) if unit[a:end] in score and vocabulary.normal[vocabulary.pieces.index(unit[a:end])])]))
        ids = codec.best(unit)
        byte = {i for i in vocabulary.byte_ids}
        assert sum(codec.byte_score if i in byte else vocabulary.scores[i] for i in ids) == pytest.approx(best[-1])


def test_pieces_as_a_unigram_library_has_them(vocabulary):
    """The same vocabulary, read by the library as a unigram model, gives the same pieces."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces.Codec(vocabulary)
    rng = random.Random(11)
    for _ in range(50):
        t = odd.text(rng, 8)
        assert sum(vocabulary.scores[i] for i in library.encode(t)) == pytest.approx(sum(vocabulary.scores[i] for i in codec.encode(t)))


def test_pieces_on_odd_tables(spark):
    docs = odd.docs(spark)
    back = pieces.decode(pieces.encode(docs))
    assert back.count() == docs.count() and back.filter("NOT (decoded <=> text)").count() == 0
    assert back.filter("text IS NULL AND piece_ids IS NOT NULL").count() == 0
    assert pieces.digest(docs).filter("NOT round_trip").count() == 0 and pieces.digest(odd.empty(spark)).count() == 0

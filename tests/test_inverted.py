"""The inverted index: the best documents by skipping blocks, held against scoring all documents."""

import math
import random
from collections import Counter

import pytest

from rampart.operators import inverted, retrieval


def plain(docs, queries, k):
    """query_id, rank, id, score by scoring every document."""
    words = [(i, t.lower().split()) for i, t in docs if t is not None]
    n, mean = len(docs), sum(len(w) for _, w in words) / max(1, len(words))
    df = Counter(x for i, w in words for x in {(i, len(w), x) for x in w})
    holders = Counter(x for _, _, x in df)
    out = []
    for q, text in queries:
        scores = Counter()
        for word, times in Counter((text or "").lower().split()).items():
            for (i, length, x) in df:
                if x == word:
                    tf = df[i, length, x] * sum(w.count(x) for j, w in words if (j, len(w)) == (i, length)) / df[i, length, x]
                    idf = math.log(1 + (n - holders[x] + 0.5) / (holders[x] + 0.5))
                    scores[i] += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean)) * times
        ranked = sorted(((-round(s, 9), i) for i, s in scores.items()))[:k]
        ranked += [(0.0, i) for i in sorted({i for i, _ in docs} - set(scores))][: k - len(ranked)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(ranked))]
    return sorted(out)


def rows(spark, docs, queries, k):
    docs, queries = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    got = retrieval.bm25_indexed(inverted.build(docs), docs, queries, k).collect()
    return sorted((r.query_id, r.rank, r.id, r.score) for r in got)


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-9)


def corpus(n=600, seed=5):
    """Texts with a word of nearly all documents, frequent and rare words, repeated and empty texts, and none."""
    draw = random.Random(seed)
    text = lambda: " ".join(["the"] * draw.randint(0, 6) + [f"w{int(draw.paretovariate(0.7))}" for _ in range(draw.randint(1, 40))])
    docs = [(i, text()) for i in range(n)]
    return docs + [(n + i, docs[7][1]) for i in range(30)] + [(n + 40, ""), (n + 41, None), (n + 42, " \t\n"), (n + 43, "The THE the")]


def asks(docs):
    return [(1, docs[7][1]), (2, docs[9][1] + " the the"), (3, "the"), (4, "w1 w2 w3 w50"), (5, "absent words"), (6, ""), (7, None), (8, "w1 W1 w1 the")]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_the_best_documents_are_those_of_scoring_all(spark, k):
    docs = corpus()
    same(rows(spark, docs, asks(docs), k), plain(docs, asks(docs), k))


@pytest.mark.parametrize("levels, block", [(1, 1), (3, 8), (200, 100_000)])
def test_any_cut_into_blocks_gives_the_same_rows(spark, monkeypatch, levels, block):
    docs = corpus(200, 11)
    monkeypatch.setattr(inverted, "LEVELS", levels)
    monkeypatch.setattr(inverted, "BLOCK", block)
    same(rows(spark, docs, asks(docs), 5), plain(docs, asks(docs), 5))


def test_no_documents_and_no_queries(spark):
    assert rows(spark, [], [(1, "a b")], 3) == []
    assert rows(spark, [(1, "a b")], [], 3) == []


def test_rows_of_one_id_add_up(spark):
    got = rows(spark, [(1, "a b c"), (1, "a"), (2, "a"), (3, "c c")], [(9, "a")], 2)
    assert [(r[1], r[2]) for r in got] == [(1, 1), (2, 2)] and got[0][3] > got[1][3]


def test_a_frequent_word_is_dealt_to_blocks_and_most_postings_are_left_unread(spark):
    docs = spark.createDataFrame([(i, "the " * (1 + i % 3) + (f"rare{i // 4}" if i < 400 else "filler more text")) for i in range(6000)], "id long, text string")
    words = inverted.asked(spark.createDataFrame([(q, f"the rare{q}") for q in range(20)], "query_id long, text string")).cache()
    index = inverted.build(docs, words)
    assert index.blocks.where("word = 'the'").count() >= 6 and index.blocks.agg({"n": "max"}).first()[0] <= 2 * inverted.BLOCK
    every = index.blocks.join(words, "word").agg({"n": "sum"}).first()[0]
    assert inverted.candidates(index, inverted.bounds(index, words, 3)).count() < every / 100

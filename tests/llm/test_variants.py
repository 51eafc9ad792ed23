"""Near vectors, spelling variants and vector codes against plain versions: ties, repeats, nulls, odd lengths, clashing names."""

import random

import numpy as np
import pytest

from rampart.llm import embedding_dedup, queries, spelling, vector_codes
from rampart.llm.common import table
from tests.llm import plain

SF = "/root/testdata/sf0.001"
KEY = lambda r: tuple((x is None, x) for x in r)


def same(got, want):
    assert sorted((tuple(r) for r in got), key=KEY) == sorted(want, key=KEY)


# Near copies of vectors


@pytest.fixture(scope="module")
def vectors():
    """Groups of copies at many distances, a chain whose ends aren't alike, equal vectors, and odd ones."""
    rng, rows = np.random.default_rng(5), []
    for _ in range(8):
        base = rng.standard_normal(12)
        rows += [base, base, base * 3] + [base + rng.standard_normal(12) * s for s in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)]
    base = rng.standard_normal(12)
    rows += [base + rng.standard_normal(12) * 0.02 for _ in range(90)]
    for _ in range(12):
        base = base + rng.standard_normal(12) * 0.35
        rows.append(base)
    rows = [(i * 3 + 1, [float(x) for x in v]) for i, v in enumerate(rows)]
    odd = [(2, None), (5, [0.0] * 12), (8, [float("nan")] * 12), (11, [None] * 12), (14, [float("inf")] + [1.0] * 11), (17, []), (None, rows[0][1]), (None, None), (None, [1.0, -1.0] * 6), (1, rows[0][1]), (1, rows[40][1])]
    odd += [(20, [9.0, 3.0, 3.0, 1.0]), (23, [10.0]), (26, [1e200, 0.0, 3e199]), (29, [1e-200, -0.0, 3e-201]), (32, [0.0, -0.0, 4.0]), (35, [-0.0, 0.0, 4.0])]
    return rows + odd


@pytest.mark.parametrize("shard, part", [(65_536, 4096), (60, 50)])
def test_near_copies(spark, vectors, shard, part):
    wide = [(i, v, 1, "x", 2.0) for i, v in vectors]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>, label int, cls string, n double")
    same(embedding_dedup.near_copies(df.repartition(3), shard=shard, part=part).collect(), plain.near_copies(vectors))


def test_near_copies_of_nothing(spark):
    assert embedding_dedup.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    (row,) = embedding_dedup.near_copies(spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")).collect()
    assert tuple(row) == (4, 0, 4, True)


def test_near_copies_of_the_table(spark):
    rows = [(r.vec_id, r.embedding and list(r.embedding)) for r in table(spark, SF, "embeddings").collect()]
    same(queries.op11_embedding_dedup(spark, SF).collect(), plain.near_copies(rows))


def test_a_graph_finds_links_of_groups_without_comparing_all():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((12_000, 32))
    for k in range(60):
        x[k * 100 : k * 100 + 40] = x[k * 100] + rng.standard_normal((40, 32)) * 0.15
    x[6000:6700] = x[6000] + rng.standard_normal((700, 32)) * 0.1
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)[rng.permutation(len(x))]
    graph = embedding_dedup.Graph(x)
    assert [len(level) for level in graph.levels] == [46, 750, 12_000]
    none = np.full(2000, -1)
    who, place = embedding_dedup.audited(graph, x[:2000], 0.9, embedding_dedup.BEAM, 200, none)
    want = x[:2000] @ x.T >= 0.9
    assert len(set(zip(who, place, strict=True))) == len(who) and want[who, place].all()
    assert len(who) >= 0.999 * want.sum()
    asked, _ = embedding_dedup.beam(x, graph.levels[-1], x[:500], graph.entries(x[:500], 2), 48)
    assert (asked >= 0).all()


def test_an_audit_widens_a_beam_that_misses():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24))
    x[::2] = x[1::2] + rng.standard_normal((1500, 24)) * 0.1
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = embedding_dedup.Graph(x)
    who, _ = embedding_dedup.audited(graph, x, 0.9, 1, len(x), np.full(len(x), -1))
    assert len(who) == (x @ x.T >= 0.9).sum()


# Spelling variants


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdefghéñß") for _ in range(rng.randrange(6, 15))) for _ in range(60)]
    stems += [s[:-1] + "z" for s in stems[:20]] + [s[:3] + s[4:] for s in stems[:20]] + ["q" + s for s in stems[:20]] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ababababa"]
    weights = [rng.choice((1, 3, 12, 150)) for _ in stems]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(stems, weights, k=rng.randrange(0, 200)))) for i in range(60)]
    long = "".join(rng.choice("abc") for _ in range(3000))
    rows += [(100, None), (101, ""), (102, "!!! 123"), (None, stems[0] + "-" + stems[1]), (None, None), (103, long), (104, long), (105, long), (106, long[:-1] + " " + long[:-1]), (107, "×÷" * 9), (107, "×÷" * 9), (5, "repeated repeated"), (5, "repeated repeated")]
    rows += [(300, "planterxy " * 3), (301, "planterx " * 40), (302, "Planter " * 500)]
    return rows + [(200 + i, long[:1500] + "c" + long[1500:]) for i in range(3)]


@pytest.mark.parametrize("block, wide", [(8192, False), (7, True)])
def test_variants(spark, texts, block, wide):
    rows = [(i, t, 1, "x", 2) for i, t in texts] if wide else texts
    df = spark.createDataFrame(rows, "doc_id long, text string" + (", n int, word string, key int" if wide else ""))
    got = spelling.variants(df.repartition(3), block=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain.variants(texts)
    assert any(w[1] for w in want) and ("planterxy", "planterx", "planter", 3, 1, 40) in want
    same(got.collect(), want)


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_recurrences_find_all_words_one_edit_apart():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(400)})
    index = spelling.Index(words)
    for q, bits, _ in index.near(words):
        found = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
        assert {index.words[k] for k in found} == {w for w in words if plain.one_apart(q, w)}


# Vector codes


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(7)
    rows = [(i * 2, [rng.choice((-1.0, -0.3, 0.0, 0.1, 0.7, rng.gauss(0, 1))) for _ in range(35)], rng.choice((1, 2, None))) for i in range(150)]
    rows += [(301, None, 1), (303, [float("nan")] * 35, 1), (305, [None] * 35, 2), (307, [float("-inf")] * 35, 2), (309, [], 3), (311, [0.5] * 20, None), (313, [0.0] * 35, 3), (315, [1e300, -1e300], 4)]
    return rows + [(None, rows[0][1], 1), (None, rows[1][1], None), (4, rows[0][1], 2), rows[5], rows[5]]


@pytest.mark.parametrize("entries, wide", [(64, False), (5, True), (256, False)])
def test_codes(spark, labelled, entries, wide):
    rows = [(i, v, x, 1.0, "y") for i, v, x in labelled] if wide else labelled
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int" + (", error double, q string" if wide else ""))
    same(vector_codes.compressed(df.repartition(3), entries=entries).collect(), plain.codes(labelled, entries=entries))


def test_codes_of_nothing_and_of_text_labels(spark):
    assert vector_codes.compressed(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    (row,) = vector_codes.compressed(spark.createDataFrame([(1, [0.25, -0.3], "x")], "vec_id long, embedding array<double>, label string")).collect()
    assert row.code == "00" * 16 and row.error == row.label_error == 0


def test_search_compares_few_entries_and_breaks_ties():
    rng = np.random.default_rng(6)
    centres = rng.integers(-500, 500, (64, 4))
    points = centres[rng.integers(0, 64, 5000)] + rng.integers(-20, 20, (5000, 4))
    at, error, compared = vector_codes.Book(centres).search(points)
    away = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (at == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
    assert compared < 0.5 * away.size
    twins = np.array([[4, 0], [0, 0], [4, 0], [0, 0], [2, 2]])
    at, error, _ = vector_codes.Book(twins).search(np.array([[0, 0], [4, 0], [2, 0], [2, 1]]))
    assert at.tolist() == [1, 0, 0, 4] and error.tolist() == [0, 0, 4, 1]

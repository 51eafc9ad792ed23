"""Joins and dedup against plain versions: ties, copies, empty and long texts, nulls, clashing names."""

import random

import pytest

from rampart.llm import decontaminate, ngram_join, suffix_dedup
from rampart.llm.components import components
from tests.llm import plain

DOCS = "doc_id long, text string"


def frame(spark, rows, more=False):
    if not more:
        return spark.createDataFrame(rows, DOCS)
    wide = [(i, t, 1, "x", 2.0, [3]) for i, t in rows]
    return spark.createDataFrame(wide, f"{DOCS}, node int, key string, n double, hits array<int>")


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, text, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text]


@pytest.fixture(scope="module")
def corpus():
    """Groups of near copies at many distances, chains of copies, a passage that many texts share, and odd texts."""
    rng, texts = random.Random(3), []
    for size in (6, 40, 90, 200):
        base = words(rng, size)
        texts += [base, base, edited(rng, base, 0.3)] + [edited(rng, base, rng.choice((0.005, 0.01, 0.02, 0.04))) for _ in range(12)]
        texts += [base[: int(size * c)] for c in (0.95, 0.88, 0.82, 0.75, 0.7, 0.6)]
    chain = words(rng, 120)
    for _ in range(8):
        chain = edited(rng, chain, 0.012)
        texts.append(chain)
    passage = words(rng, 60)
    texts += [words(rng, 15) + passage + words(rng, 10) for _ in range(25)] + [words(rng, 30) + passage for _ in range(10)]
    texts += [["one"], ["one"], ["one", "two"], ["a"] * 50, ["a"] * 60, words(rng, 20_000)]
    rows = [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \t\n "), (903, "ÄRGER\u00a0x ärger"), (904, "ONE\x0btwo"), (None, rows[0][1]), (None, None), (5, "repeated row of seven words is here"), (5, "repeated row of seven words is here")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("wide", [False, True])
def test_ngram_components(spark, corpus, monkeypatch, wide):
    if wide:  # shingles of two nodes count as common
        monkeypatch.setattr(ngram_join, "COMMON_OF", 1)
        monkeypatch.setattr(ngram_join, "COMMON", 2)
    got = [tuple(r) for r in ngram_join.ngram_components(frame(spark, corpus, wide).repartition(5)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain.ngram_components(corpus), key=key)


def test_ngram_components_of_nothing(spark):
    assert ngram_join.ngram_components(frame(spark, [])).collect() == []
    assert ngram_join.keep_one(frame(spark, [])).collect() == []


def test_keep_one_keeps_columns_and_one_of_each_group(spark, corpus):
    df = frame(spark, corpus, True)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    want = sorted({c for i, _, c in plain.ngram_components(corpus) if i is not None})
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want


def test_common_tokens_take_no_join_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_OF", 4)
    monkeypatch.setattr(ngram_join, "COMMON", 8)
    rows = [(t, n) for n in range(200) for t in (1, 2, 1000 + n, 5000 + n // 2)]
    counted = ngram_join._counted(spark.createDataFrame(rows, "token long, node long"))
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = counted.collect()
    assert sorted((r.token, r.node) for r in got) == sorted(r for r in rows if not 1000 <= r[0] < 1200)
    df = {(r.token, r.df) for r in got}
    assert len(df) == len({t for t, _ in df}) and all(n == 2 if t >= 5000 else n > 2 for t, n in df)


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)} | {200: 200, 201: 200}


@pytest.fixture(scope="module")
def repeating():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    shared = [text(n) for n in (399, 400, 401, 700, 1500)]
    rows = [(i, text(rng.randrange(50, 900)) + rng.choice(shared) + text(rng.randrange(0, 600))) for i in range(30)]
    rows += [(40 + i, text(100) + shared[3][:300] + text(2) + shared[3][300:]) for i in range(3)]
    long = text(3000)
    rows += [(50, long), (51, long), (52, long[:1500] + "Z" + long[1500:]), (53, "x" * 900), (54, "ab" * 450), (55, long[5:]), (56, text(300) * 4)]
    rows += [(60, None), (61, ""), (62, "short"), (63, "short"), (64, "é" * 500), (None, long), (70, text(800)), (71, shared[4] + text(20_000) + shared[4])]
    rows += [(70, "other text under one number " * 20), (80, text(500)), (80, rows[0][1])]
    return rows


@pytest.mark.parametrize("wide, hot", [(False, suffix_dedup.HOT), (True, 1)])
def test_repeats(spark, repeating, monkeypatch, wide, hot):
    if hot == 1:  # every pair of two anchors counts as common, every gram as hot
        monkeypatch.setattr(suffix_dedup, "COMMON_OF", 1)
        monkeypatch.setattr(suffix_dedup, "COMMON", 2)
    got = [tuple(r) for r in suffix_dedup.repeats_report(frame(spark, repeating, wide).repartition(4), hot=hot).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain.repeats(repeating), key=key)


def test_doubling_reads_each_table_once(spark, repeating):
    more = ["b", "cover", "inner", "need"]
    signed = suffix_dedup._signatures(frame(spark, repeating), 400).where("places is not null")
    suffixes = signed.selectExpr("row", "posexplode(a) as (i, a)", *more).selectExpr("row", "i", "a", *(f"{c}[i] as {c}" for c in more))
    ranked, _, made = suffix_dedup.doubled(suffixes)
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == len(made) > 1


def test_repeats_of_nothing(spark):
    assert suffix_dedup.repeats_report(frame(spark, [])).collect() == []


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    return [(i, " ".join(words(rng, n))) for i, n in enumerate((40, 20, 13, 12, 3, 1))] + [(90, None), (91, "  "), (10, " ".join(words(random.Random(5), 40)))]


@pytest.mark.parametrize("wide, slices", [(False, 1 << 20), (True, 300)])
def test_decontamination(spark, items, wide, slices):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 80)) + items[i % 6][1].split()[: rng.randrange(1, 30)] + words(rng, 40))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, items[0][1].upper().replace(" ", " -- ")), (103, "é" + items[1][1]), (104, items[2][1] + "x"), (None, items[2][1])]
    rows += [(105, " ".join(words(rng, 30_000)) + " " + items[0][1]), (106, items[1][1]), (106, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.decontamination_report(frame(spark, rows, wide), bench, slice_bytes=slices).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    want = plain.contamination(rows, items)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = decontaminate.drop_contaminated(frame(spark, rows, wide), bench)
    assert kept.count() == sum(not w[-1] for w in want) and kept.columns == frame(spark, rows, wide).columns
    clean = decontaminate.remove_spans(frame(spark, rows), bench)
    assert decontaminate.decontamination_report(clean, bench).where("doc_id = 102").first().n_words == 0


def test_decontamination_without_a_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontamination_report(frame(spark, [(1, "a b")]), none).first().contaminated is False
    assert decontaminate.decontamination_report(frame(spark, []), none).collect() == []


# Counter-examples of earlier versions


def test_texts_under_one_number_or_none_are_kept(spark):
    a, b = "one two three four five six seven eight", "nothing of the other text is in this one here"
    rows = [(1, a), (5, a), (5, b), (7, b + " again and again and more"), (None, a), (None, "quite another text without any number at all"), (None, None), (9, None), (9, None)]
    kept = ngram_join.keep_one(frame(spark, rows).selectExpr("*", "doc_id as h1"))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()))
    want = [(1, a), (5, b), (7, b + " again and again and more"), (None, "quite another text without any number at all"), (None, None), (9, None), (9, None)]
    assert got == sorted((i is None, i or 0, t or "") for i, t in want)


def test_periodic_texts_stay_small(spark):
    rows = [(1, "a" * 60_000), (2, "ab" * 20_000), (3, "abc" * 9_000 + "xyz"), (4, "ba" * 300)]
    texts = suffix_dedup._signatures(frame(spark, rows), 400)
    chosen = texts.selectExpr("row", "text", "places", "filter(sequence(0, size(places) - 1), i -> places[i] >= 74 and places[i] - 74 <= length(text) - 400) as chosen")
    assert suffix_dedup._stretches(chosen, 400).selectExpr("sum(length(bytes))").first()[0] < 2 * sum(len(t) for _, t in rows)
    got = sorted(tuple(r) for r in suffix_dedup.repeats_report(frame(spark, rows)).collect())
    assert got == sorted(plain.repeats(rows))


def test_a_hits_column_and_sentences_of_many_items(spark):
    shared = " ".join(f"s{i}" for i in range(15))
    items = spark.createDataFrame([(i, f"{shared} own{i}") for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " . ".join([shared] * 5), ["x"])], "doc_id long, text string, hits array<string>")
    found = decontaminate.find_hits(docs, items)
    assert found.columns == ["doc_id", "text", "hits", "_hits"]
    r = found.first()
    assert len(r["_hits"]["items"]) == 300 and len(r["_hits"]["runs"]) <= 5 and r["_hits"].n_words == 75
    sliced = decontaminate.find_hits(docs, items, slice_bytes=3000).first()
    assert sorted(sliced["_hits"]["items"]) == sorted(r["_hits"]["items"])
    assert sum(x.n for x in sliced["_hits"].runs) == sum(x.n for x in r["_hits"].runs) == 75


def _overlapping(count=12):
    """Texts that share blocks of words with those around them, each too few to be similar, and one near copy."""
    blocks = [" ".join(f"b{b}w{i}" for i in range(30)) for b in range(2 * count)]
    texts = [" ".join(blocks[(2 * t + i) % len(blocks)] for i in range(10)) for t in range(count)]
    return [(i, t) for i, t in enumerate([*texts, texts[3] + " more"])]


def test_few_open_pairs_need_one_round(spark, monkeypatch):
    """Rounds are what the driver's memory goes by: each has its own exchanges and broadcasts."""
    rows, rounds, compare = _overlapping(), [], ngram_join._compare
    monkeypatch.setattr(ngram_join, "_compare", lambda pairs, *a: compare(rounds.append(pairs.count()) or pairs, *a))
    got = [tuple(r) for r in ngram_join.ngram_components(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(plain.ngram_components(rows))
    assert len(rounds) == 1 and 0 < rounds[0] <= len(rows) * (len(rows) - 1) / 2  # a pair is compared once


def test_rounds_of_few_heads_agree_with_brute_force(spark, monkeypatch):
    rows, rounds, round_ = _overlapping(), [], ngram_join._round
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 0)
    monkeypatch.setattr(ngram_join, "_round", lambda *a: rounds.append(a[2]) or round_(*a))
    got = [tuple(r) for r in ngram_join.ngram_components(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(plain.ngram_components(rows))
    assert len(rounds) > 1 and None not in rounds

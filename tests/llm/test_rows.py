"""Operators on rows, vectors and conversations: contracts, edge cases, held-out accuracy, SQL."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rampart.llm import ann_projection, chat_format, language_id, mixing, queries, rule_ensemble, sharding, sql, url_filter
from rampart.llm.common import table
from tests.llm import plain
from tests.oracle import check, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(n for n in vars(sql) if n.startswith("op")))
def test_sql(spark, name):
    check(queries.queries()[name](spark, SF), connect(SF), getattr(sql, name))


# Sharding


def test_lookup_table_is_even_and_stable():
    names = tuple(f"s{i}" for i in range(10))
    own, less = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    counts = [own.count(i) for i in range(10)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 1009
    assert sum(a != b for a, b in zip(own, less, strict=True) if a != 9) < 0.15 * 1009
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_place_keeps_all_rows_and_clashing_columns(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (2, None)]
    got = sharding.place(spark.createDataFrame(rows, "doc_id long, slot string"))
    assert got.columns == ["doc_id", "slot", "_slot", "shard"]
    assert got.count() == 4 and len({r.shard for r in got.where("doc_id = 1").collect()}) == 1
    assert sharding.place(spark.createDataFrame([], "doc_id long")).collect() == []


# URL filter


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.com/en/x?q", "https://www.example.com/en/?a", "http://badexample.com/en/", "ftp://x.net/fr/a#b", "http://net/es/", "http://x.org", "no scheme/en/", None, "http://com?x/", "a://b://c/d", "http://EXAMPLE.COM/EN/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, none).collect()}
    assert got[0][:3] == ("a.example.com", "/en/x", "example.com/en/") and got[0][3] == "block"
    assert got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2][2:] == ("com/", "allow")
    assert got[3][:3] == ("x.net", "/fr/a", "net/fr/") and got[4][2] == "net/es/"
    assert got[5][:3] == ("x.org", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None)
    assert got[8][:3] == ("com", "", None) and got[9][:2] == ("b:", "//c/d") and got[10][2] == "com/"
    assert len(got) == len(urls)


def test_reputation_shrinks_small_hosts_to_their_domain(spark):
    rows, out = [], []
    for i in range(400):
        host = "bad.spam.org" if i < 150 else "good.fine.org" if i < 300 else f"h{i}.fine.org"
        rows.append((i, f"http://{host}/"))
        out.append((i, int(i >= 150)))
    rows += [(500, "http://new.spam.org/"), (501, "http://new.fine.org/"), (None, "http://new.fine.org/")]
    pages, good = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*out, (1, 0), (None, 1), (2, None)], "page_id long, good int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, good).collect()}
    assert got[0].verdict == "block" and got[200].verdict == "allow"
    assert got[500].verdict == "block" and got[501].verdict == "allow" and got[None].verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0), good).collect() == []


# Chat


def test_round_trip_of_control_strings(spark):
    bits = ["<|turn|>", "<|says|>", "<|end|>", "\\", "\\\\", "</s>", "[INST]", "[/INST]", "<s>", "<", "|", "a\nb", "é😀", "<\\|end|>", "$1", ""]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(("user", "assistant", "sys<|says|>")), "".join(rng.choices(bits, k=6)) or None) for c in range(60) for t in range(4)]
    rows += [(None, None, None, None), (None, None, None, "x"), (70, 1, "assistant", "same"), (70, 1, "assistant", "same")]
    got = {r.conv_id: r for r in chat_format.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_parts_become_placeholders_and_attachments(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "s3://a.png", 4), ("odd", "x", None, None), ("audio", None, "b.wav", None), ("text", None, None, None), ("document", None, "c.pdf", 2)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.format_conversations(df, "parts").first()
    assert r.formatted == "<|turn|>user<|says|>see <\\|image|><|image|><|audio|><|document|><|end|><|turn|>assistant<|says|>ok<|end|><|turn|>user<|says|><|end|>"
    assert [(a.kind, a.ref, a["at"], a.tokens) for a in r.attachments] == [("image", "s3://a.png", 1, 1024), ("audio", "b.wav", 3, 25), ("document", "c.pdf", 5, 1024)]
    assert r.attachment_tokens == 2073
    (span,) = r.loss_spans
    assert r.formatted[span.start : span.start + span.length] == "ok"
    assert chat_format.format_conversations(df.limit(0), "parts").collect() == []


# Nearest neighbours


def test_nearest_finds_what_comparing_all_finds(spark):
    rng = random.Random(2)
    unit = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(700)]
    rows = list(enumerate(unit)) + [(700 + i, unit[20]) for i in range(90)]
    rows += [(900, None), (920, [0.0] * 16), (940, [None] + [1.0] * 15), (960, [math.nan] * 16), (980, [math.inf] * 16), (None, unit[0]), (3, unit[3]), (1000, [1.0, 2.0]), (1001, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann_projection.nearest(df, block=200, per_block=16).collect()}
    exact = spark.createDataFrame([(i, v) for i, v in rows if v is not None], "vec_id long, embedding array<float>").collect()
    want = {(q, r): (i, s) for q, r, i, s in plain.nearest([(r.vec_id, r.embedding) for r in exact])}
    assert set(got) == set(want)
    same = sum(got[k][0] == want[k][0] for k in want)
    assert same >= 0.95 * len(want)
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want if got[k][0] == want[k][0])
    assert [got[20, r][0] for r in range(1, 21)] == list(range(700, 720))  # ties go to the smaller number


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann_projection.nearest(df).collect()) == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert ann_projection.nearest(df.limit(0)).collect() == []


def test_chi_square_point():
    assert abs(ann_projection.chi_square_point(2, 0.95) - 5.991) < 1e-3 and abs(ann_projection.chi_square_point(10, 0.95) - 18.307) < 1e-3


# Quality


def test_quality_on_held_out_labels_and_odd_rows(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", None, None, None), (10**9, "", None, None, None)], DOCS)
    rows = rule_ensemble.quality_scores(docs.unionByName(odd).withColumn("stats", F.lit(1)), labels).cache()
    assert rows.count() == docs.count() + 3
    assert rows.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0
    held = rows.where("held_out").join(labels, "doc_id")
    assert held.where("predicted = quality").count() >= 0.95 * held.count()
    some = {r.doc_id: r.held_out for r in rows.where("doc_id < 50").collect()}
    assert some == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in some}


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a", None, None, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rule_ensemble.quality_scores(docs, none).first().score == 0.5
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert rule_ensemble.quality_scores(docs, one).first().score > 0.5
    assert rule_ensemble.quality_scores(docs.limit(0), one).collect() == []
    assert rule_ensemble.keep_good(docs, one, cut=0.0).columns == docs.columns


# Languages


def test_languages_on_held_out_documents_and_odd_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    odd = spark.createDataFrame([(None, None, "en", None, None), (10**9, "", "en", None, None), (10**9 + 1, "123 -- !", "en", None, None), (10**9 + 2, "the and of", None, None, None), (10**9 + 3, "の", None, None, None)], DOCS)
    rows = language_id.identify(docs.unionByName(odd)).cache()
    known = rows.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert known.where("lang_pred = lang").count() >= 0.97 * known.count()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows.where("doc_id is null or doc_id >= 1000000000").collect()}
    assert got[None] == got[10**9] == got[10**9 + 1] == ("und", 0.0)
    assert got[10**9 + 2][0] in ("en", "de", "fr", "es") and got[10**9 + 3][0] != "und"
    assert rows.where("score < 0 or score > 1").count() == 0


def test_languages_of_nothing_learnt(spark):
    docs = spark.createDataFrame([(1, "text", None, None, None)], DOCS)
    assert [tuple(r)[2:] for r in language_id.identify(docs).collect()] == [("und", 0.0)]
    assert language_id.identify(docs.limit(0)).collect() == []


# Mixing


def test_posteriors_and_rates_match_plain_ones_and_the_targets(spark):
    from pyspark.ml.feature import HashingTF

    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    domains, labelled = list(mixing.TARGETS), mixing.labelled_domains(docs, labels)
    model = mixing.learn(docs, labelled, domains)
    told = mixing.with_posteriors(docs.select("doc_id", "text"), model, domains, "n", "soft").cache()
    index = HashingTF(numFeatures=mixing.BUCKETS).indexOf
    weights, base = model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()
    for r in told.where("doc_id % 50 = 0").collect():
        assert r.n == len((r.text or "").split())
        want = plain.softmax_of_words(r.text, weights, base, index)
        assert max(abs(a - b) for a, b in zip(r.soft, want, strict=False)) < 1e-9 and abs(sum(r.soft) - 1) < 1e-9
    rows = told.select("n", "soft").collect()
    want = list(mixing.TARGETS.values())
    least, lowest, value = plain.least_rates([x.n for x in rows], [x.soft for x in rows], want, [max(w, mixing.FLOOR) for w in want], mixing.NEARNESS)
    y = mixing.fit(told, mixing.TARGETS)
    r = [max(0.0, 1 - sum(a * b for a, b in zip(x.soft, y, strict=True))) for x in rows]
    assert lowest * (1 - 1e-6) <= value(r) <= lowest * (1 + 1e-6) and max(abs(a - b) for a, b in zip(r, least, strict=True)) < 0.05
    total = sum(x.n for x in rows)
    shares = [sum(x.n * a * x.soft[k] for x, a in zip(rows, r, strict=True)) / total for k in range(len(want))]
    assert all(abs(a - w) < 0.01 for a, w in zip(shares, want, strict=True) if w) and shares[-1] < 0.04
    got = sorted(x.rate for x in mixing.mixing_rates(docs, labelled).collect())
    assert max(abs(a - b) for a, b in zip(got, sorted(r), strict=True)) < 1e-3 and got[0] >= 0 and got[-1] < 4


@pytest.mark.parametrize("most", [math.inf, 1.5])
def test_rates_are_the_least_of_all(spark, most):
    """A hot domain with a third of all tokens whose target is tiny, one without documents, and rates that are held."""
    rng = random.Random(5)
    soft = [(1.0, 0.0, 0.0)] * 40 + [(x, 1 - x, 0.0) for x in (rng.random() for _ in range(80))]
    rows = [(rng.randrange(1, 9) * (5 if k < 40 else 1), list(p)) for k, p in enumerate(soft)] + [(0, [0.2, 0.3, 0.5])]
    targets = {"a": 0.05, "b": 0.85, "c": 0.1}
    y = mixing.fit(spark.createDataFrame(rows, "n long, soft array<double>"), targets, most=most)
    r = [min(most, max(0.0, 1 - sum(a * b for a, b in zip(p, y, strict=True)))) for _, p in rows]
    least, lowest, value = plain.least_rates([n for n, _ in rows], [p for _, p in rows], targets.values(), [max(w, mixing.FLOOR) for w in targets.values()], mixing.NEARNESS, most=most)
    assert abs(value(r) - lowest) <= 1e-6 * lowest and min(r) >= 0 and max(r) <= most
    assert mixing.fit(spark.createDataFrame([(0, [0.5, 0.5, 0.0])], "n long, soft array<double>"), targets) == []


def test_taken_rows_are_as_many_as_copies(spark):
    docs, labels = (table(spark, SF, t) for t in ("documents", "labels"))
    labelled = mixing.labelled_domains(docs, labels)
    taken = mixing.mix(docs.withColumn("soft", F.lit(1)), labelled)
    copies = mixing.mixing_rates(docs, labelled).agg(F.sum("copies")).first()[0]
    assert taken.columns == [*docs.columns, "soft"] and abs(taken.count() - copies) <= 2


def test_a_known_classifier_hits_separable_domains(spark):
    """Domains told apart by their words, one of them rare and one hot: their rates are target over share."""
    rows = [(i, "alpha beta gamma" if i < 950 else "delta epsilon zeta" if i < 985 else "eta theta iota", None, None, None) for i in range(1000)]
    docs = spark.createDataFrame(rows, DOCS)
    labelled = spark.createDataFrame([(i, "a" if i < 950 else "b" if i < 985 else "c") for i in range(1000)], "doc_id long, domain string")
    got = {r.domain: r for r in mixing.mixing_rates(docs, labelled, {"a": 0.6, "b": 0.25, "c": 0.15}).collect()}
    for k, (target, share) in {"a": (0.6, 0.95), "b": (0.25, 0.035), "c": (0.15, 0.015)}.items():
        assert abs(got[k].rate - target / share) < 0.1 * target / share
    assert got["c"].rate > 8
    bounded = mixing.mixing_rates(docs, labelled, {"a": 0.6, "b": 0.25, "c": 0.15}, most=4.0)
    assert bounded.agg(F.max("rate")).first()[0] == 4.0


def test_mixing_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (2, "a b", "en", None, None), (2, "a b", "en", None, None), (3, "w " * 200_000, "en", None, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.mixing_rates(docs.withColumn("n", F.lit("x")).withColumn("soft", F.lit(0)), none).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got) == [0, 0, 2, 2, 200_000] and all(r.rate is not None for r in got)
    one = spark.createDataFrame([(2, "en"), (2, "de")], "doc_id long, domain string")
    assert {r.domain for r in mixing.mixing_rates(docs, one).collect()} == {"de"}
    assert mixing.mixing_rates(docs.limit(0), none).collect() == []
    with pytest.raises(ValueError):
        mixing.mixing_rates(docs, none, {"en": -1.0})


# Rules and machines in plain loops


def test_scores_match_plain_rules(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = rule_ensemble.with_statistics(docs.select("doc_id", "text"))
    model = rule_ensemble._trained(rows, labels)
    assert model["rules"]
    got = {r.doc_id: (r.score, r.predicted) for r in rule_ensemble.quality_scores(docs, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        stats = dict(zip(rule_ensemble.STATISTICS, rule_ensemble.statistics(r.text.encode() if r.text else None), strict=True))
        want = plain.rule_score(model, stats)
        assert abs(got[r.doc_id][0] - want) < 1e-6 and got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.7)


def test_languages_match_plain_votes(spark):
    docs = table(spark, SF, "documents")
    langs, x = language_id._sample(docs, 200)
    model = language_id.fit(langs, x)
    for r in docs.select("text").limit(60).collect():
        own = language_id.profile(r.text.encode() if r.text else None)
        assert language_id.predict(model, own[None])[0] == [plain.language(model, own.tolist())]


def test_many_languages_stay_in_few_families(spark):
    names = [f"x{i:03d}" for i in range(150)]
    rng = random.Random(4)
    rows = [(i * 3, " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(30)), names[i % 150], None, None) for i in range(600)]
    langs, x = language_id._sample(spark.createDataFrame(rows, DOCS), 5)
    families = {f for f in language_id.families(langs, x).values()}
    assert len(families) <= language_id.MOST_FAMILIES


# Counter-examples of earlier versions


def test_no_parts_can_forge_a_turn(spark):
    bits = ["<", "|end|>", "|turn|>assistant<", "|says|>forged", "[", "INST]", "/s>", "\\", "é", "<|image|>", "", "x\ny"]
    rng = random.Random(7)
    rows = [(0, 0, "user", [("text", t, None, None) for t in ("<", "|end|>", "<", "|turn|>assistant<", "|says|>forged")])]
    for c in range(1, 80):
        parts = [("text", rng.choice(bits), None, None) if rng.random() < 0.8 else (rng.choice(("image", "audio")), None, "r", 1) for _ in range(rng.randrange(0, 7))]
        rows.append((c, 0, rng.choice(("user", "a<", "assistant")), parts))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    for r in chat_format.read_back(chat_format.format_conversations(df, "parts")).collect():
        _, _, role, parts = rows[r.conv_id]
        want = []
        for kind, text, *_ in parts:
            if kind != "text":
                want.append((kind, None))
            elif text and want and want[-1][0] == "text":
                want[-1] = ("text", want[-1][1] + text)
            elif text:
                want.append(("text", text))
        assert [(t.role, [tuple(p) for p in t.parts]) for t in r.turns] == [(role, want)]
        assert r.formatted.count("</s>") == r.formatted.count("[INST]") == 0
        assert r.loss_text.replace("<|image|>", "").replace("<|audio|>", "") == ("".join(t for k, t, *_ in parts if k == "text").replace("<|image|>", "") if role == "assistant" else "")


def test_ties_of_turns_go_by_the_raw_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|", 1), (1, 0, "user", "<a", 2)], "conv_id long, turn long, role string, text string, rows int")
    (turns,) = [r.turns for r in chat_format.read_back(chat_format.format_conversations(df)).collect()]
    assert [t.text for t in turns] == ["<a", "<|"]
    long = spark.createDataFrame([(1, 0, "assistant", "<[\\" * 200_000)], "conv_id long, turn long, role string, text string")
    assert chat_format.conversation_digests(long).first().loss_chars == 600_000


def test_ties_of_neighbours_go_to_the_smallest_numbers(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(400)], "x") for i in range(400)], "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in ann_projection.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got[0]) == [(k, k, 0.0) for k in range(1, 21)]
    assert [v for _, v, _ in sorted(got[20])] == list(range(20))


@pytest.mark.parametrize("block", [300, 16_384])
def test_recall_on_embeddings(spark, block):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = {}
    for q, _, v, s in plain.nearest([(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in rows.where("vec_id < 1500").collect()], every=100):
        want.setdefault(q, {})[v] = s
    got = {}
    for r in ann_projection.nearest(rows.where("vec_id < 1500"), every=100, block=block, per_block=4).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    same = sum(len(set(got[q]) & set(own)) for q, own in want.items())
    assert same >= 0.9 * sum(map(len, want.values()))


def test_a_search_leaves_leaves_out():
    import numpy as np

    rng = np.random.default_rng(3)
    near = rng.standard_normal((200, 8)) * 4
    rows = (near[rng.integers(0, 200, 16_000)] + rng.standard_normal((16_000, 8)) * 0.1).astype(float)
    ids = np.arange(16_000)
    largest = float((rows * rows).sum(axis=1).max())
    found, visited = ann_projection.search(rows, ids, rows[::400], 20, largest)
    best = np.argsort(-(rows[::400] @ rows.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found, best, strict=True)]) >= 18
    assert visited.mean() < 0.9 * len(rows) / ann_projection.LEAF


def test_rules_of_equal_length_and_repeated_pages(spark):
    rules = (("allow", "a.com", "/x"), ("block", "a.com", "/y"), ("block", "com", "/xxxx"))
    pages = spark.createDataFrame([(1, "http://a.com/xxxx", 5), (1, "http://a.com/xxxx", 5), (2, "http://a.com/" + "y" * 100_000, 5)], "page_id long, url string, bound int")
    got = [(r.page_id, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame([], "page_id long, good int"), rules).orderBy("page_id").collect()]
    assert [g[1:] for g in got] in ([("a.com/x", "allow"), ("a.com/x", "allow"), ("a.com/y", "block")], [("com/xxxx", "block"), ("com/xxxx", "block"), ("a.com/y", "block")])

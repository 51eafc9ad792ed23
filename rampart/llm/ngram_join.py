"""N-gram Jaccard join: exact, by prefix lists of shingles, with skips over blocks of a list and over known answers.

1. Each text becomes its set of hashed shingles; equal sets are one class, of which one row, the node, goes on.
2. A set's `probe` is its first shingles in hash order: as many as may miss in a similar set, plus `extra` of them.
   Two similar sets share `extra` shingles of their probes at least, so by the prefix filter they also share one of
   those that remain when each probe drops its `extra - 1` commonest. Commonest is counted over all probes; a shingle
   of one set alone makes no list. Most sets keep no shared shingle and leave here; only the others go on whole.
3. Lists: the nodes that keep one shingle, now by the counts of whole sets, a node's rarest shingles first, as many as
   the prefix filter needs. A node with more shingles of its own than a similar set may miss keeps none.
4. Each list is cut in blocks by set size and by the shingle's position in the node's order. In a round, each open list
   names heads, which only meet the blocks whose sizes and positions leave enough overlap; the other blocks are skipped.
   Nodes of the head's component are skipped too. Heads grow fourfold each round; a list is closed when one component
   holds all its nodes or each was a head. Once all open lists have few pairs, each node is a head and no round follows,
   as a round costs the driver more than those pairs cost the executors.
5. Answers of a head are derived from those of its lead, the head that it shares most with: where the lead was compared
   with a node, their overlap, plus what the head has beyond its lead, bounds the head's overlap with that node, and
   pairs that the bound excludes are answered without a comparison.
6. Pairs that remain are compared exactly on the sets of their whole texts. Links between classes give components.

Hashes have 64 bits for shingles and 128 for sets and rows. Shingles that a sample of nodes shows to be very common are
never dealt by themselves, and the sample's count stands for theirs; it only decides where rows go and in which order, the
same for all nodes, a node's shingles come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.llm.common import SMALL_ROWS, WordHash, discard, free_name, sliced, small_side, windows, written
from rampart.llm.components import components

SIZE, PERCENT = 5, 80
#: One node of COMMON_OF is looked at for common shingles, and one that COMMON of them have is common.
COMMON_OF, COMMON = 16, 32
#: Blocks of positions in a list: twentieths of the node's set.
POSITIONS = 20
#: Pairs in open lists that are met in one round.
FEW_PAIRS = 1 << 14


def shingle_set(text: bytes | None, seen: WordHash, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of a text's shingles of lower-cased words; of the whole sequence if it has fewer words."""
    words = text.lower().split() if text else []
    return np.unique(windows(seen.of(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def needed(n, percent: int = PERCENT):
    """The least overlap of a set of n with any similar set."""
    return -(-percent * n // 100)


def extra(n):
    return n // 20 + 1


def probe_size(n: int, percent: int = PERCENT) -> int:
    return min(n, n - needed(n, percent) + extra(n))


def row_marks(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell rows apart by number and text; rows equal in both are repeated."""
    return F.xxhash64(F.lit(1), doc_id, text).alias("h1"), F.xxhash64(F.lit(2), text, doc_id).alias("h2")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, h1, h2 of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.select("doc_id", "text", *row_marks(F.col("doc_id"), F.col("text")))


def _signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """row, doc_id, h1, h2, n, key, probe of every row of docs; only the first of equal sets in a task has a probe."""
    schema = "doc_id long, h1 long, h2 long, n int, key binary, probe array<long>"
    names = ["doc_id", "h1", "h2", "n", "key", "probe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = WordHash(), set()
        for batch in sliced(batches, "text"):
            ns, keys, probes = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, seen, size)
                key = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                probes.append(own[: probe_size(len(own), percent)].view(np.int64) if len(own) and key not in known else None)
                known.add(key)
                ns.append(len(own))
                keys.append(key)
            made = [pa.array(ns, pa.int32()), pa.array(keys, pa.binary()), pa.array(probes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *made], names=names)

    return written(_texts(docs).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def _needed(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def _counted(tokens: DataFrame) -> DataFrame:
    """tokens(token, node, ...) with df, how many have the token; those of one node alone go.

    Tokens are dealt by token once and counted where they lie. Rows of common tokens are dealt out evenly instead, so no task
    holds all rows of one; their df is what the sample makes it, as df only sets an order, and one that all nodes agree on.
    """
    seen = tokens.where(F.pmod(F.xxhash64("node"), F.lit(COMMON_OF)) == 0)
    common = seen.groupBy("token").agg((F.count("node") * COMMON_OF).alias("known")).where(F.col("known") >= COMMON * COMMON_OF)
    deal = F.when(F.col("known").isNull(), F.col("token")).otherwise(F.xxhash64("token", "node"))
    dealt = tokens.join(small_side(written(common)), "token", "left").withColumn("deal", deal).repartition("deal")
    df = F.coalesce("known", F.count("*").over(Window.partitionBy("deal")))
    return dealt.withColumn("df", df).where("df > 1").drop("known", "deal")


def _prefix_lists(tokens: DataFrame, whole: Column, kept: Column) -> DataFrame:
    """token, node, n, pos, alone: of tokens(token, node, n), each node's rarest ones that other nodes have too.

    `whole` is how many tokens a node has, `kept` how many of them its prefix has; pos counts from 1 in the order of the
    prefix, and `alone` tokens that no other node has come first.
    """
    ranked = _counted(tokens).selectExpr(
        "*",
        "row_number() over (partition by node order by df, token) as place",
        "count(*) over (partition by node) as shared",
    )
    ranked = ranked.withColumn("alone", whole - F.col("shared")).withColumn("pos", F.col("alone") + F.col("place"))
    return ranked.where(F.col("pos") <= kept).select("token", "node", "n", "pos", "alone")


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """The nodes of nodes(node, n, probe) whose prefixes share a token with another's."""
    n = F.col("n")
    needs = _needed(n, percent)
    whole = F.least(n.cast("long"), n - needs + F.floor(n / 20) + 1)
    kept = whole - F.floor(needs / 20)  # all but extra - 1 of the smallest set that may be similar
    return _prefix_lists(nodes.select("node", "n", F.explode("probe").alias("token")), whole, kept).select("node").distinct()


def _lists(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The lists of the whole sets of texts(node, text)."""

    def run(batches):
        seen = WordHash()
        for batch in sliced(batches, "text"):
            sets = [shingle_set(t, seen, size).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(map(len, sets)), pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    n = F.col("n")
    sets = written(texts.mapInArrow(run, "node long, n int, tokens array<long>"))
    lists = written(_prefix_lists(sets.select("node", "n", F.explode("tokens").alias("token")), n, n - _needed(n, percent) + 1))
    busy = written(lists.groupBy("token").agg(F.count("node").alias("m")).where("m > 1").select("token"))
    out = written(lists.join(small_side(busy), "token", "left_semi"))
    discard(sets, lists, busy)
    return out


def _band(n: Column, percent: int) -> Column:
    """Sizes that can match are in the same band or the next."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.01 * 100 / percent))).cast("int")


def _place(pos: Column, n: Column) -> Column:
    """The block of a position in a node's order."""
    return F.floor((pos - 1) * POSITIONS / n).cast("int")


def _met_blocks(n: Column, percent: int) -> Column:
    """(band, place) of the blocks that a head of n may match: later positions leave too little overlap."""
    base = F.lit(1.01 * 100 / percent)

    def of(band: Column) -> Column:
        most = F.pow(base, band + 1)  # the largest size of the band
        last = F.floor(POSITIONS * (1 - percent * (1 + n / most) / (100 + percent)) + 1e-6).cast("int")
        places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        return F.when(last >= 0, F.transform(places, lambda place: F.struct(band.alias("band"), place.alias("place"))))

    blocks = [of(_band(n, percent) + i) for i in (-1, 0, 1)]
    return F.flatten(F.array_compact(F.array(*blocks)))


def _pairs_left(lists: DataFrame) -> float:
    """How many pairs of nodes the lists have, a pair counted in each list that has both."""
    m = F.col("m").cast("double")
    return lists.groupBy("token").agg(F.count("node").alias("m")).agg(F.sum(m * (m - 1) / 2)).first()[0] or 0.0


def _round(lists: DataFrame, labels: DataFrame | None, heads_each: int | None, percent: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Pairs (a: head, b, n_a, n_b) to compare, the lists that stay open, and the table of heads.

    Without heads_each every node is a head, a pair has its smaller node first, and no list stays open.
    """
    own = lists.join(labels, "node", "left") if labels is not None else lists.withColumn("label", F.lit(None).cast("long"))
    own = own.withColumn("linked", F.col("label").isNotNull() & F.lit(heads_each != 1)).withColumn("label", F.coalesce("label", "node"))
    part = F.pmod(F.xxhash64("node"), F.lit(heads_each)) if heads_each else F.col("node")
    heads = own.groupBy("token", part.alias("part")).agg(
        F.min(F.struct("linked", "alone", "node", "n", "pos", "label")).alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    heads = heads.selectExpr("*", "min(lo) over (partition by token) as least", "max(hi) over (partition by token) as most").where("least < most")
    heads = written(heads.select("token", *(F.col(f"h.{c}").alias(f"h_{c}") for c in ("node", "n", "pos", "label"))))
    by_block = heads.withColumn("block", F.explode(_met_blocks(F.col("h_n"), percent)))
    by_block = by_block.select("*", "block.band", "block.place").drop("block")
    both = F.floor(((F.col("n") + F.col("h_n")) * percent + 99 + percent) / (100 + percent))  # the overlap that similar sets need
    pairs = (
        own.withColumns({"band": _band(F.col("n"), percent), "place": _place(F.col("pos"), F.col("n"))})
        .join(by_block, ["token", "band", "place"])
        .where(F.col("label") != F.col("h_label") if heads_each else (F.col("label") != F.col("h_label")) & (F.col("h_node") < F.col("node")))
        .where(F.least("n", "h_n") * 100 >= F.greatest("n", "h_n") * percent)
        .where((F.col("pos") <= F.col("n") - both + 1) & (F.col("h_pos") <= F.col("h_n") - both + 1))
        .select(F.col("h_node").alias("a"), F.col("node").alias("b"), F.col("h_n").alias("n_a"), F.col("n").alias("n_b"))
        .distinct()
    )
    if not heads_each:
        return pairs, None, heads
    used = heads.groupBy("token").agg(F.collect_list("h_node").alias("used"))
    used = F.broadcast(used) if heads.count() <= SMALL_ROWS else used
    rest = lists.join(used, "token").where(~F.array_contains("used", F.col("node"))).select(lists.columns)
    return pairs, rest, heads


def similar(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return common * 100 >= (n_a + n_b - common) * percent


def _derived(pairs: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    """The pairs that neither were compared before nor are excluded by what the head's lead shares with the node.

    compared(a, b, n_a, n_b, common). The lead of a node is the head, of those it is similar to, that it shares most with.
    """
    alike = compared.where(similar(F.col("common"), F.col("n_a"), F.col("n_b"), percent))
    lead = alike.groupBy(F.col("b").alias("a")).agg(F.max_by(F.struct(F.col("a").alias("lead"), F.col("common").alias("lead_common")), "common").alias("l"))
    lead = lead.select("a", "l.lead", "l.lead_common")
    known = compared.select(F.col("a").alias("lead"), "b", F.col("common").alias("lead_b"))
    bound = F.least(F.col("lead_b") + F.col("n_a") - F.col("lead_common"), "n_a", "n_b")
    asked = pairs.join(lead, "a", "left").join(known, ["lead", "b"], "left")
    asked = asked.where(F.col("lead_b").isNull() | similar(bound, F.col("n_a"), F.col("n_b"), percent)).select(pairs.columns)
    done = compared.select("a", "b").union(compared.select("b", "a"))
    return asked.join(done, ["a", "b"], "left_anti")


def _compare(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """pairs(a, b, n_a, n_b) with common, how many shingles both have."""
    first, second = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    names = ["a", "b", "n_a", "n_b"]

    def run(batches):
        seen, last = WordHash(), (None, None)
        for batch in sliced(batches, "text_b"):
            a, b, common = batch.column("a").to_pylist(), batch.column("text_b").to_pylist(), []
            texts_a = batch.column("text_a")
            for i, node in enumerate(a):
                if node != last[0]:
                    last = node, shingle_set(texts_a[i].as_py(), seen, size)
                common.append(len(np.intersect1d(last[1], shingle_set(b[i], seen, size), assume_unique=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(common, pa.int32())], names=[*names, "common"])

    both = pairs.join(second, "b").join(first, "a").select(*names, "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, n_a int, n_b int, common int")


def similar_classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, h1, h2, n, node) of every row of docs, node null for empty sets; links (a, b) that join all similar
    nodes; (node, label) of the components that they make.

    Links span the components of the similarity graph between nodes; pairs inside a component that follow from
    others aren't all listed.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    rows = _signatures(docs, size, percent)
    probed = rows.where("probe is not null")
    firsts = written(probed.groupBy("key").agg(F.min("row").alias("node")))
    others = written(probed.select("row", "key").join(firsts, "key").where("row != node").select("row"))  # equal sets of different tasks
    lead = probed.join(small_side(others), "row", "left_anti")
    ids = written(_candidates(lead.withColumnRenamed("row", "node"), percent))
    wanted = written(rows.select(F.col("row").alias("node"), "h1", "h2").join(small_side(ids), "node", "left_semi"))
    members = written(rows.select("row", "doc_id", "h1", "h2", "n", "key").join(firsts, "key", "left").drop("key"))
    discard(rows, firsts, others, ids)
    texts = written(_texts(docs).join(small_side(wanted), ["h1", "h2"]).select("node", "text").dropDuplicates(["node"]))
    lists = _lists(texts, size, percent)
    compared, links, labels, heads_each = None, None, None, 1
    while lists is not None and (left := _pairs_left(lists)):
        pairs, rest, heads = _round(lists, labels, heads_each if left > FEW_PAIRS else None, percent)
        pairs = written(_derived(pairs, compared, percent) if compared is not None else pairs)
        found = written(_compare(pairs, texts, size))
        if compared is not None:
            before, compared = (compared, found), written(compared.union(found))
            discard(*before)
        else:
            compared = found
        rest = written(rest) if rest is not None else None
        discard(pairs, heads, lists)
        lists, heads_each = rest, heads_each * 4
        links = compared.where(similar(F.col("common"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
        discard(labels)
        labels = written(components(links))
    discard(lists)
    discard(texts, wanted)
    if links is None:
        links, labels = (docs.sparkSession.createDataFrame([], s) for s in ("a long, b long", "node long, label long"))
    return members, links, labels


def ngram_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach. Null and empty texts have no shingles and are linked with
    nothing: their component is their own id. Rows with a null id take part in links and get their component's id.
    Repeated rows each get a row.
    """
    members, _, labels = similar_classes(docs, size, percent)
    members = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = written(members.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("smallest")))  # so that a large component's rows aren't dealt by it
    return members.join(small_side(smallest), "label", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null last), then the first.

    Rows are told apart by number and text, so different texts under one number, or under none, each count. Texts without
    words are linked with nothing: all of their rows stay.
    """
    members, _, labels = similar_classes(docs, size, percent)
    told = members.where("node is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    best = written(told.groupBy("label").agg(F.min_by(F.struct("h1", "h2"), order).alias("b"), F.count("*").alias("c")).where("c > 1").select("label", "b.*"))
    stays = (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2"))
    met = told.join(small_side(best).withColumnsRenamed({"h1": "b1", "h2": "b2"}), "label")
    met = written(met.groupBy("h1", "h2").agg(F.max(stays).alias("stays"), F.count("*").alias("c")).where("not stays or c > 1"))
    discard(best)
    gone, again = met.where("not stays").select("h1", "h2"), met.where("stays").select("h1", "h2")
    m1, m2 = free_name(docs, "h1"), free_name(docs, "h2")
    marks = row_marks(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    marked = docs.withColumns({m1: marks[0], m2: marks[1]})
    named = lambda df: small_side(df).withColumnsRenamed({"h1": m1, "h2": m2})
    kept = marked.join(named(gone), [m1, m2], "left_anti")
    if not again.isEmpty():
        once = kept.join(named(again), [m1, m2], "left_semi").dropDuplicates([m1, m2])
        kept = kept.join(named(again), [m1, m2], "left_anti").unionByName(once)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))

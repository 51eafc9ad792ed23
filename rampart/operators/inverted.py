"""An inverted index whose postings lie in blocks with the largest gain of each, and the best documents by skipping blocks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rampart.storage import discard, few, written

K1, B = 1.5, 0.75
#: Levels of gain that a word's postings are cut into, and about how many postings of a level a block holds.
LEVELS, BLOCK = 16, 1_024
#: A query's words that name the documents scored first, and how many times k each of them names.
FIRST_WORDS, FIRST_TIMES = 8, 4
#: Scores are rounded to PLACES; a bound keeps whatever lies within SLACK of it, so that no tie is lost.
PLACES, SLACK = 9, 1e-6


class Index(NamedTuple):
    """blocks(word, top, low, n, postings(gain, id)): best first in a block; lists(id, words(word, gain)): a document's gains."""

    blocks: DataFrame
    lists: DataFrame


def tokens(text):
    """Words of the lower-cased text, split at spaces, tabs and line ends."""
    return F.array_remove(F.split(F.lower(text), r"[ \t\n\r]+"), "")


def asked(queries: DataFrame) -> DataFrame:
    """query_id, word, times: the words of queries(query_id, text); a word counts as often as it stands."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))


def build(docs: DataFrame, only: DataFrame | None = None) -> Index:
    """The index of docs(id, text) by Okapi BM25, idf never negative; of the words in only(word), or of all.

    A word's postings are dealt to blocks by level of gain and by a hash of the document, so a word of most documents is never
    one group, and a block holds about BLOCK of them. Rows of the same id add up. Texts without words, and null, have no postings.
    """
    words = docs.select("id", tokens(F.col("text")).alias("words"))
    stats = words.agg(F.count("*").alias("docs"), F.avg(F.size("words")).alias("mean"))
    terms = words.select("id", F.size("words").alias("len"), F.explode("words").alias("word"))
    if only is not None:
        terms = terms.join(few(only.select("word").distinct()), "word", "left_semi")
    tf = written(terms.groupBy("id", "len", "word").agg(F.count("*").alias("tf")))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    gains = tf.join(few(df), "word").crossJoin(F.broadcast(stats))  # one row of statistics
    # a gain lies below idf * (K1 + 1), so its share of that is a level; rows of one id, added up, may pass the last
    gains = gains.select("id", "word", "df", gain.alias("gain"), (gain / idf / (K1 + 1) * LEVELS).cast("int").alias("level"))
    gains = written(gains.groupBy("id", "word", "df").agg(F.sum("gain").alias("gain"), F.max("level").alias("level")))
    deal = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / BLOCK))
    blocks = gains.groupBy("word", "level", deal.alias("part")).agg(
        F.max("gain").alias("top"), F.min("gain").alias("low"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("gain", "id")), asc=False).alias("postings")
    )
    lists = gains.groupBy("id").agg(F.collect_list(F.struct("word", "gain")).alias("words"))
    out = Index(written(blocks.drop("level", "part")), written(lists))
    discard(tf, gains)
    return out


def _scored(index: Index, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, id, score of pairs(query_id, id), from the gains of the whole document."""
    met = pairs.join(index.lists, "id").select("query_id", "id", F.explode("words").alias("w")).select("query_id", "id", "w.*")
    return met.join(few(words), ["query_id", "word"]).groupBy("query_id", "id").agg(F.round(F.sum(F.col("gain") * F.col("times")), PLACES).alias("score"))


def bounds(index: Index, words: DataFrame, k: int) -> DataFrame:
    """query_id, word, times, rest, need: the words of queries that the index has.

    `need` is a score that k documents of the query reach, 0 where that isn't known: the k-th best of the documents that its words
    of most weight name first. `rest` is the most that the words of less weight can add.
    """
    tops = index.blocks.groupBy("word").agg(F.max("top").alias("top"))
    order = W.partitionBy("query_id").orderBy("most", "word")
    own = words.join(few(tops), "word").withColumn("most", F.col("top") * F.col("times"))
    own = own.withColumn("rest", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    own = own.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("most"), F.desc("word"))))
    own = written(own.select("query_id", "word", "times", "rest", "place"))
    lead = own.where(F.col("place") <= FIRST_WORDS)
    # the blocks that hold a word's best postings: the best of each, and of those the best of all
    first = index.blocks.join(few(lead.select("word").distinct()), "word", "left_semi")
    first = first.withColumn("at", F.row_number().over(W.partitionBy("word").orderBy(F.desc("top")))).where(F.col("at") <= FIRST_TIMES)
    first = first.select("word", F.explode(F.slice("postings", 1, FIRST_TIMES * k)).alias("p")).select("word", "p.*")
    first = first.withColumn("at", F.row_number().over(W.partitionBy("word").orderBy(F.desc("gain"), "id"))).where(F.col("at") <= FIRST_TIMES * k)
    seeds = lead.join(first, "word").select("query_id", "id").distinct()
    best = _scored(index, seeds, words).withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"))))
    need = written(best.where(F.col("at") == k).select("query_id", F.col("score").alias("need")))
    return own.join(few(need), "query_id", "left").select("query_id", "word", "times", "rest", F.coalesce("need", F.lit(0.0)).alias("need"))


def candidates(index: Index, bound: DataFrame) -> DataFrame:
    """query_id, id, once for each posting read: every document that can be among its query's best is there.

    A document's score is at most the gain of its word of most weight and the rest below that word, so that posting passes.
    Blocks whose largest gain doesn't pass are left out before their postings are unpacked.
    """
    may = lambda gain: F.col("rest") + F.col(gain) * F.col("times") >= F.col("need") - SLACK
    blocks = index.blocks.join(few(bound), "word").where(may("top"))
    return blocks.select("query_id", "times", "rest", "need", F.explode("postings").alias("p")).select("query_id", "times", "rest", "need", "p.*").where(may("gain")).select("query_id", "id")


def search(index: Index, words: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: documents of words(query_id, word, times), the k best and all that tie with them among them."""
    return _scored(index, candidates(index, bounds(index, words, k)).distinct(), words)

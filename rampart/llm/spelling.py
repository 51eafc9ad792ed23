"""Spelling variant grouping: a bit-sliced position index over the vocabulary finds all words one edit apart.

The vocabulary is counted from runs of letters; some occurrences lose a letter by a rule on their document (seeded typing
errors). A word's form is a near word at least TIMES as frequent, and its root is where following forms ends.

For each (position, letter) the index holds a bitset: the words of a block with that letter there. A query's letters are
taken in turn, and all words of the block are followed at once, 64 to a machine word:

    zero error   Z' = Z & B(i, c)
    replaced     S' = S & B(i, c)  |  Z & ~B(i, c)
    left out     D' = D & B(i-1, c)  |  Z             the query has a letter more; the word's positions are one behind
    put in       I' = (I | Z) & B(i+1, c)             the word has a letter more; its positions are one ahead

Words stand by falling length, so a bitset ends with the last word that reaches its position, and deep positions of long
words cost little. Queries are taken in order, and states of common prefixes are kept.

Of two words one edit apart, the first or the last h letters agree, h half the length of the indexed one (at most 6). So a
word is indexed under both of these keys, and asks with its own letters under those of the three lengths it can meet. A
block holds the words of some keys, BLOCK on average. A key with more words is dealt to several blocks, each of which all
of its queries visit. A pair counts under its first letters, and under its last ones only if the first ones differ.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import discard, small_side, written

LETTERS, SHORTEST, OFTEN, EVERY, TIMES = "A-Za-zÀ-ÿ", 7, 2, 31, 10
BLOCK, KEY = 8192, 6


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN, every: int = EVERY) -> DataFrame:
    """word, n of docs(doc_id, text): how often each word of `shortest` letters or more occurs, `often` times at least.

    Runs shorter than that can't become such words, so they never leave the pattern.
    """
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(low, F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))).alias("w"))
    h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
    cut = F.pmod(h, F.char_length("w"))
    typed = F.when(h % every == 0, F.concat(F.substring("w", F.lit(1), cut.cast("int")), F.substring("w", (cut + 2).cast("int"), F.char_length("w")))).otherwise(F.col("w"))
    words = runs.select(typed.alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


class Index:
    """Bitsets over words by (position, letter), words by falling length."""

    def __init__(self, words: list[str]):
        self.words = sorted(words, key=lambda w: (-len(w), w))
        sizes = np.array([len(w) for w in self.words])
        longest = int(sizes[0]) if len(sizes) else 0
        reach = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest + 3))
        self.width = ((reach + 63) // 64).tolist()  # machine words that hold all words of at least this length
        self.none = np.zeros(self.width[0], np.uint64)
        self.every = self._set(range(len(self.words)))
        by_size: dict[int, list[int]] = defaultdict(list)
        at: dict[tuple[int, str], list[int]] = defaultdict(list)
        for k, w in enumerate(self.words):
            by_size[len(w)].append(k)
            for place in enumerate(w):
                at[place].append(k)
        self.of_size = {size: self._set(ks) for size, ks in by_size.items()}
        self.at = {(i, c): self._set(ks, self._width(i + 1)) for (i, c), ks in at.items()}

    def _width(self, size: int) -> int:
        return self.width[size] if size < len(self.width) else 0

    def _set(self, places, width: int | None = None) -> np.ndarray:
        out = np.zeros(self.width[0] if width is None else width, np.uint64)
        places = np.fromiter(places, np.int64)
        np.bitwise_or.at(out, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        return out

    def _step(self, state, i: int, c: str):
        zero, replaced, behind, ahead = state
        here, before, after = self._width(i + 1), self._width(i), self._width(i + 2)
        b1 = self.at.get((i, c), self.none[:here])
        z = zero[:here]
        replaced = (replaced[:here] & b1) | (z & ~b1)
        b0 = self.at.get((i - 1, c), self.none[:before])
        behind = (behind[:before] & b0) | zero[:before]
        b2 = self.at.get((i + 1, c), self.none[:after])
        ahead = (ahead[:after] | zero[:after]) & b2
        return z & b1, replaced, behind, ahead

    def near(self, queries: list[str]):
        """(query, bitset of the words one edit from it, states by prefix length) of sorted queries; states are shared."""
        states, last = [(self.every, self.none, self.none, self.none)], ""
        for q in queries:
            same = 0
            for a, b in zip(q, last, strict=False):
                if a != b:
                    break
                same += 1
            del states[same + 1 :]
            for i in range(same, len(q)):
                states.append(self._step(states[-1], i, q[i]))
            last, out = q, self.none.copy()
            zero, replaced, behind, ahead = states[-1]
            for bits, size in ((replaced, len(q)), (behind, len(q) - 1), (ahead, len(q) + 1), (zero, len(q) + 1)):
                if size in self.of_size:
                    out[: len(bits)] |= bits & self.of_size[size][: len(bits)]
            yield q, out, states


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def search_block(index: pa.Table, asked: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: what the words of asked(key, query) find of index(key, word, n) under their keys."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    if index.num_rows and asked.num_rows:
        counts = dict(zip(index["word"].to_pylist(), index["n"].to_pylist(), strict=True))
        own = Index(list(counts))
        place = {w: k for k, w in enumerate(own.words)}
        under: dict[str, list[int]] = defaultdict(list)
        for key, w in zip(index["key"].to_pylist(), index["word"].to_pylist(), strict=True):
            under[key].append(place[w])
        sets = {key: own._set(ks) for key, ks in under.items()}
        order = sorted(range(len(own.words)), key=lambda k: (-counts[own.words[k]], own.words[k]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys: dict[str, list[str]] = defaultdict(list)
        for key, w in zip(asked["key"].to_pylist(), asked["query"].to_pylist(), strict=True):
            keys[w].append(key)
        for q, bits, states in own.near(sorted(keys)):
            if not bits.any():
                continue
            found = own.none.copy()
            for key in keys[q]:
                if key in sets:
                    hits = bits & sets[key]
                    if key[0] == ">":
                        same = states[int(key[1])][0]
                        hits[: len(same)] &= ~same
                    found |= hits
            places = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
            if len(places):
                best = own.words[order[int(rank[places].min())]]
                for column, value in zip(out, (q, len(places), counts[best], best), strict=True):
                    column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)


def _ends(word: Column, h: Column) -> Column:
    """The keys of a word's first and last h letters."""
    first, last = F.concat(F.lit("<"), h.cast("string"), F.substring(word, F.lit(1), h)), F.concat(F.lit(">"), h.cast("string"), F.substring(word, F.char_length(word) - h + 1, h))
    return F.array(first, last)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n, best of the written words(word, n): how many words are one edit away, and the most frequent, ties
    to the first in code-point order. Words without any aren't in it. Words have 2 letters at least."""
    size = F.char_length("word")
    half = lambda more: F.least(F.floor((size + more) / 2), F.lit(KEY)).cast("int")
    index = words.select("word", "n", F.explode(_ends(F.col("word"), half(0))).alias("key"))
    hs = F.array_distinct(F.filter(F.array(half(-1), half(0), half(1)), lambda h: h > 0))
    asked = words.select(F.col("word").alias("query"), F.explode(F.flatten(F.transform(hs, lambda h: _ends(F.col("word"), h)))).alias("key"))
    crowded = written(index.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1"))
    crowded_keys, blocks = small_side(crowded), max(1, -(-2 * words.count() // block))
    parts = F.coalesce("parts", F.lit(1))
    number = lambda part: F.pmod(F.xxhash64("key", part), F.lit(blocks)).cast("int").alias("block")
    held = index.join(crowded_keys, "key", "left").select(number(F.pmod(F.xxhash64("word"), parts).cast("int")), "key", "word", "n")
    sent = asked.join(crowded_keys, "key", "left").select("key", "query", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    sent = sent.select(number(F.col("part")), "key", "query")
    found = held.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(search_block, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    out = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best"))
    discard(crowded)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the written forms(word, form): where following forms ends. A form is more frequent than its word, so it ends."""
    now, moved = written(forms.select("word", F.col("form").alias("root"))), True
    while moved:
        to = small_side(now.select(F.col("word").alias("root"), F.col("root").alias("next")))
        step = written(now.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not step.where("moved").isEmpty()
        discard(now)
        now = step
    return now.select("word", "root")


def variants(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN, every: int = EVERY, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of docs(doc_id, text).

    Null and empty texts have no words; a null doc_id counts as an empty one; rows that repeat count as often as they stand;
    other columns are left out. Runs and words may be of any length. Of near words that are equally frequent the first in
    code-point order is the form. Without documents there are no rows.
    """
    words = written(vocabulary(docs, shortest, often, every))
    near = near_words(words, block)
    told = words.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    form, form_n = (F.when(F.col("is_form"), F.col(c)) for c in ("best", "best_n"))
    told = written(told.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n")))
    discard(words, near)
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Language ID by hierarchical discrimination: the family first, then the languages within it.

A text's profile is the hashed counts of two- and three-byte strings of the whole text, case and marks left out. Linear
support vector machines tell families from one another, and then, one versus one, the languages of the family; votes
decide, then margins. They are fitted on the driver on at most SAMPLE labelled texts of each language, chosen by a hash
of their ids, and GATHERED texts of all; only their profiles are gathered. Languages that the table of families doesn't name
are put together by their mean profiles, into MOST_FAMILIES families at most, so that machines don't grow with all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart.llm.common import sliced

SIZE, SAMPLE, UNKNOWN = 1024, 1500, "und"
GATHERED, MOST_FAMILIES = 60_000, 12
#: Language families by ISO 639-1 codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and bool(_LETTER.search(text) or any(c.isalpha() for c in text.decode("utf-8", "replace")))


def profile(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of hashed two- and three-byte strings: a vector of length 1, or 0 for no letters."""
    out = np.zeros(SIZE, np.float32)
    data = np.frombuffer((text or b"").translate(_FOLD), np.uint8)
    if len(data) < 2:
        return out
    data = data[np.concatenate(([True], (data[1:] != 0x20) | (data[:-1] != 0x20)))].astype(np.uint32)
    two = data[:-1] * np.uint32(257) + data[1:]
    three = two[:-1] * np.uint32(263) + data[2:] + np.uint32(1 << 20)
    for grams in (two, three):
        if len(grams):
            out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(22), minlength=SIZE).astype(np.float32)
    return np.sqrt(out / max(1.0, float(out.sum())))


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 40, batch: int = 64, weight: float = 1e-4) -> np.ndarray:
    """Weights, and last the offset, of a linear support vector machine for y = 1 or -1; both sides weigh the same.

    Averaged stochastic subgradient steps on the hinge loss.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    order = np.random.default_rng(5)
    total = rounds * -(-len(x) // batch)
    for _ in range(rounds):
        for own in np.array_split(order.permutation(len(x)), -(-len(x) // batch)):
            step += 1
            wrong = y[own] * (x[own] @ w) < 1
            slope = weight * w - (each[own] * y[own] * wrong) @ x[own] / len(own)
            w = w - slope * 8 / np.sqrt(step)
            if step > total // 2:
                mean += (w - mean) / (step - total // 2)
    return mean


def families(langs: list[str], profiles: np.ndarray) -> dict[str, str]:
    """The family of each language: as the table says, else with the nearest of a few far apart, by mean profile."""
    named = {lang: family for family, own in FAMILIES.items() for lang in own}
    own = np.array(langs)
    other = sorted(set(langs) - set(named))
    means = {lang: profiles[own == lang].mean(axis=0) for lang in other}
    seeds = other[:1]
    away = {lang: np.inf for lang in other}
    while len(seeds) < min(len(other), MOST_FAMILIES - len(FAMILIES)):
        for lang in other:
            away[lang] = min(away[lang], float(((means[lang] - means[seeds[-1]]) ** 2).sum()))
        seeds.append(max(other, key=lambda lang: (away[lang], lang)))
    near = {lang: min(seeds, key=lambda s, lang=lang: (float(((means[lang] - means[s]) ** 2).sum()), s)) for lang in other}
    return {lang: named.get(lang) or f"like {near[lang]}" for lang in set(langs)}


def fit(langs: list[str], profiles: np.ndarray) -> dict:
    """Machines by pair of families and by pair of languages of one family."""
    family_of = families(langs, profiles)
    langs_of: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        langs_of.setdefault(family_of[lang], []).append(lang)
    own = np.array(langs)
    kinds = np.array([family_of[x] for x in langs])

    def machine(kind, a, b):
        both = (kind == a) | (kind == b)
        return linear_svm(profiles[both], np.where(kind[both] == a, 1.0, -1.0))

    pairs = {(a, b): machine(kinds, a, b) for a, b in combinations(sorted(langs_of), 2)}
    within = {(a, b): machine(own, a, b) for some in langs_of.values() for a, b in combinations(some, 2)}
    return {"languages": langs_of, "families": pairs, "within": within}


def _vote(names: list[str], machines: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The name that wins most pairs for each row, margins deciding ties, and its least margin."""
    if len(names) == 1:
        return [names[0]] * len(x), np.full(len(x), 9.0)
    wins, least = np.zeros((len(x), len(names))), np.full((len(x), len(names)), 9.0)
    for (a, b), w in ((p, w) for p, w in machines.items() if p[0] in names and p[1] in names):
        m = x @ w[:-1] + w[-1]
        for name, own in ((a, m), (b, -m)):
            i = names.index(name)
            wins[:, i] += (own > 0) + 1e-3 * np.tanh(own)
            least[:, i] = np.minimum(least[:, i], own)
    best = wins.argmax(axis=1)
    return [names[i] for i in best], least[np.arange(len(x)), best]


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and their scores, from 0 to 1: the logistic of twice the least margin on the way."""
    families, margin = _vote(sorted(model["languages"]), model["families"], x)
    out = [UNKNOWN] * len(x)
    for family in set(families):
        own = np.array([i for i, f in enumerate(families) if f == family])
        langs, inner = _vote(model["languages"][family], model["within"], x[own])
        margin[own] = np.minimum(margin[own], inner)
        for i, lang in zip(own, langs, strict=True):
            out[i] = lang
    return out, 1 / (1 + np.exp(-2 * margin))


def held_out(doc_id: Column) -> Column:
    """Documents never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _sample(docs: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
    """Languages and profiles of at most `most` texts of each language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("c"))
    each = max(1, min(most, GATHERED // max(1, counts.count())))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.least(F.lit(1.0), 0.9 * each / F.col("c")) * (1 << 30)
    chosen = rows.join(F.broadcast(counts), "lang").where(draw).select("lang", F.col("text").cast("string").cast("binary").alias("text"))  # a row for each language

    def run(batches):
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            good = pa.array([has_letter(t) for t in texts], pa.bool_())
            made = pa.array([profile(t).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), made], names=["lang", "profile"]).filter(good)

    got = chosen.mapInArrow(run, "lang string, profile binary").toArrow()
    x = np.frombuffer(b"".join(got["profile"].to_pylist()), np.float32).reshape(-1, SIZE)
    return got["lang"].to_pylist(), x


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs(doc_id, text, lang).

    Texts that are null or have no letter, and all texts if no language is known, are `und` with score 0. Repeated
    rows each get theirs.
    """
    langs, x = _sample(docs, sample)
    sent = docs.sparkSession.sparkContext.broadcast(fit(langs, x) if langs else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            out, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if has_letter(t)] if sent.value else []
            if some:
                said, sure = predict(sent.value, np.stack([profile(texts[i]) for i in some]))
                scores[some] = sure
                for i, lang in zip(some, said, strict=True):
                    out[i] = lang
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    kind = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, lang_pred string, score double").fields])
    return own.mapInArrow(run, kind)

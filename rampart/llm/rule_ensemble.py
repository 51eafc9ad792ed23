"""Quality classifier: a sparse ensemble of rules over statistics of whole texts.

A random forest is grown on the labelled rows; every path from a root to a node below it becomes a conjunctive rule on
statistics. A lasso logistic regression weighs the rules, most get no weight, and those that stay are compiled into
one Spark column expression, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart.llm.common import free_name, sliced, written

#: Statistics of a text, all 0 for an empty or null one.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "mark", "pipe", "shout", "odd_mark", "non_ascii",
    "distinct_words", "echo", "distinct_lines", "line_words", "short_words", "stops",
)
TREES, DEPTH, PENALTY, CUT = 20, 3, 0.001, 0.7
Rule = tuple[tuple[str, bool, float], ...]

_KIND = np.zeros((256, 6))
for _c in range(256):
    _KIND[_c] = (
        0x41 <= _c <= 0x5A, 0x30 <= _c <= 0x39, 0x21 <= _c <= 0x2F or 0x3A <= _c <= 0x40 or 0x5B <= _c <= 0x60 or 0x7B <= _c <= 0x7E,
        _c == 0x7C, _c == 0x21, chr(_c) in "#$%&*@^~=<>{}\\",
    )


def statistics(text: bytes | None) -> list[float]:
    words = text.split() if text else []
    if not words:
        return [float(np.log1p(len(text or b"")))] + [0.0] * (len(STATISTICS) - 1)
    n, m = len(text), len(words)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digit, mark, pipe, shout, odd = (seen @ _KIND).tolist()
    lines = text.split(b"\n")
    echo = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(m)), (n - m) / m, upper / n, digit / n, mark / n, pipe / m, shout / m, odd / m, int(seen[128:].sum()) / n,
        len(set(words)) / m**0.9, echo / m, len(set(lines)) / len(lines), m / len(lines), sum(len(w) < 4 for w in words) / m, text.count(b".") / m,
    ]


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """docs with a struct column of the statistics of each whole text."""
    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            rows = np.array([statistics(t) for t in batch.column(text_col).cast(pa.binary()).to_pylist()]).reshape(-1, len(STATISTICS))
            own = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATISTICS))], names=list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def tree_rules(node, names: tuple[str, ...], path: Rule = ()) -> set[Rule]:
    """The conjunctions on the way to every node below the root; of two bounds on one side the tighter stays."""
    out = {path} if path else set()
    if node.subtreeDepth():
        name, at = names[node.split().featureIndex()], float(node.split().threshold())
        for above, child in ((False, node.leftChild()), (True, node.rightChild())):
            rest = tuple(c for c in path if c[:2] != (name, above))
            out |= tree_rules(child, names, tuple(sorted((*rest, (name, above, at)))))
    return out


def compiled(rule: Rule, stats: str = "stats") -> Column:
    """1 where the rule holds, else 0."""
    sides = [F.col(f"{stats}.{s}") > at if above else F.col(f"{stats}.{s}") <= at for s, above, at in rule]
    return reduce(Column.__and__, sides).cast("double")


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 11) -> dict:
    """Weighted rules from rows (stats, label 0 or 1): {"base": log-odds, "rules": {rule: weight}}.

    With labels of one kind only, or none, there are no rules, and the base is what the labels say.
    """
    good, n = labelled.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("label")).first()
    if not 0 < good < n:
        return {"base": float(np.log((good + 1) / (n - good + 1))), "rules": {}}
    columns = [F.col(f"stats.{s}").alias(s) for s in STATISTICS]
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(labelled.select("label", *columns)).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.5, minInstancesPerNode=5).fit(rows)
    rules = sorted(set().union(*(tree_rules(t._call_java("rootNode"), STATISTICS) for t in forest.trees)))
    if not rules:
        return {"base": float(np.log((good + 1) / (n - good + 1))), "rules": {}}
    held = labelled.select(F.col("label").cast("double"), *(compiled(r).alias(f"r{i}") for i, r in enumerate(rules)))
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held).select("label", "features")
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(held)
    weights = {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6}
    return {"base": float(lasso.intercept), "rules": weights}


def score(model: dict, stats: str = "stats") -> Column:
    odds = reduce(Column.__add__, (compiled(r, stats) * w for r, w in model["rules"].items()), F.lit(model["base"]))
    return 1 / (1 + F.exp(-odds))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _trained(rows: DataFrame, labels: DataFrame) -> dict:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    return fit(rows.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("stats", "label").persist())


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text).

    A document labelled twice counts by its higher label; null and empty texts are scored by their zero statistics;
    a null doc_id matches no label and isn't held out.
    """
    rows = written(with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("doc_id", "stats"))
    likely = score(_trained(rows, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), likely.alias("score"), (likely >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs that score at least `cut`, with their own columns."""
    stats = free_name(docs, "stats")
    rows = written(with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("doc_id", "stats"))
    model = _trained(rows, labels)
    return with_statistics(docs, name=stats).where(score(model, stats) >= cut).select(*(F.col(f"`{c}`") for c in docs.columns))

"""Joins and rankings of findings: containing functions, duplicates of scanners, truth and prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blocks(start: Column, end: Column) -> Column:
    """The aligned blocks of 1, 2, 4, ... lines that a span of lines is made of, two of each size at most: their level and number."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.ceil(start / size), F.floor((end + 1) / size)
        first = F.when((low < high) & (low % 2 != 0), F.struct(level.alias("level"), low.alias("block")))
        last = F.when((low < high) & (high % 2 != 0), F.struct(level.alias("level"), (high - 1).alias("block")))
        return F.array_compact(F.array(first, last))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2(end.cast("long") - start + 1)).cast("int")), at))


def containing(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """find, fn: the function with the least span that holds each finding's line, of the same path or else base name.

    findings(find, file, line), functions(fn, file, start, end). A span is made of aligned blocks of 1, 2, 4, ... lines, and of
    each block of a file only the best function stays, so each line that is asked for, once, looks up one row a size: neither
    functions nor findings of a place ever meet each other. Base names are only asked for where no function of a path holds
    the line. Ties: span, start, fn.
    """
    fns = functions.where(F.col("end") >= F.col("start"))
    rank = F.struct((F.col("end") - F.col("start")).alias("span"), "start", "fn").alias("b")
    spans = fns.groupBy("file", "start", "end").agg(F.min("fn").alias("fn")).select("file", rank, F.explode(_blocks(F.col("start"), F.col("end"))).alias("at"))
    spans = spans.groupBy("file", "at.level", "at.block").agg(F.min("b").alias("b"))
    levels = spans.agg(F.collect_set("level").alias("levels"))  # one row, as many numbers as the longest span has binary digits
    places = findings.select("file", "line").distinct()

    def within(asked: DataFrame, spans: DataFrame, key: str) -> DataFrame:
        lines = asked.crossJoin(F.broadcast(levels)).select(key, "line", F.explode("levels").alias("level"))
        lines = lines.withColumn("block", F.floor(F.col("line") / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))))
        return lines.join(spans, [key, "level", "block"]).groupBy(key, "line").agg(F.min("b").alias("b"))

    base = F.substring_index("file", "/", -1).alias("base")
    same = within(places, spans, "file")
    rest = places.join(same, ["file", "line"], "left_anti").select("file", base, "line")
    by_base = spans.groupBy(base, "level", "block").agg(F.min("b").alias("b"))
    other = rest.join(within(rest.select("base", "line").distinct(), by_base, "base"), ["base", "line"])
    best = same.select("file", "line", F.struct(F.lit(False).alias("other"), "b").alias("b")).union(other.select("file", "line", F.struct(F.lit(True).alias("other"), "b").alias("b")))
    return findings.join(best, ["file", "line"]).groupBy("find").agg(F.min("b").alias("b")).select("find", "b.b.fn")


def dedupe_scans(findings: DataFrame) -> DataFrame:
    """One finding for each file, line and weakness (or rule): the longest description, then the source that sorts first."""
    kind = F.coalesce(F.nullif("cwe_id", F.lit("")), "rule_id")
    rest = [c for c in findings.columns if c not in ("file", "line")]
    best = F.min_by(F.struct(*rest), F.struct(-F.length("description"), "source", "seq"))
    return findings.withColumn("_kind", kind).groupBy("file", "line", "_kind").agg(best.alias("r")).select("file", "line", "r.*").select(*findings.columns)


def kappa(pairs: DataFrame) -> DataFrame:
    """n, agreement, expected, kappa of pairs(truth, guess), from their counts: one row."""
    cells = pairs.groupBy("truth", "guess").agg(F.count("*").alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col("truth").alias("k")).agg(F.sum("c").alias("a"))
    right = cells.groupBy(F.col("guess").alias("k")).agg(F.sum("c").alias("b"))
    by_chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("chance"))
    p, e = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return n.crossJoin(by_chance).select("n", p.alias("agreement"), e.alias("expected"), F.when(e == 1, 1.0).otherwise((p - e) / (1 - e)).alias("kappa"))


def detection(pairs: DataFrame) -> DataFrame:
    """Counts and rates of pairs(truth, guess) of booleans: one row."""
    t, g = F.col("truth"), F.col("guess")
    counts = pairs.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count("*").alias("n"))
    return counts.select(
        "tp", "fp", "fn", "n", F.expr("try_divide(tp, tp + fp)").alias("precision"), F.expr("try_divide(tp, tp + fn)").alias("recall")
    )


def truth(findings: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    """gid, f, and columns `more` of the findings: findings(f, cwe_id, file, title) that mean known(gid, cwe_id, file, title): the
    same weakness, or a path that ends in the known file and a title with one of the known title's words of more than four letters.

    Both arms are equality joins: on the weakness, and on the last characters of the path, as many as each known file has.
    """
    by_cwe = findings.join(known.where("cwe_id is not null and cwe_id <> ''").select("gid", "cwe_id"), "cwe_id").select("gid", "f", *more)
    files = known.where("file is not null and file <> ''").select("gid", F.col("file").alias("tail"), F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.length(w) > 4).alias("words"))
    lengths = files.agg(F.collect_set(F.length("tail")).alias("lengths"))  # one row; few lengths
    ends = F.array_distinct(F.transform("lengths", lambda n: F.right("file", n)))
    tails = findings.crossJoin(F.broadcast(lengths)).select("f", "title", *more, F.explode(ends).alias("tail"))
    by_file = tails.join(files, "tail").where(F.exists("words", lambda w: F.contains(F.lower(F.coalesce("title", F.lit(""))), w))).select("gid", "f", *more)
    return by_cwe.union(by_file).distinct()


def _alike(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows(key, cwe_id, file, title) by what they say: classes(key, said, n), key the least of a class, and members(key, said)."""
    members = rows.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("cwe_id", "file", "title"))).alias("said"))
    return members.groupBy("said").agg(F.min(key).alias(key), F.count("*").alias("n")), members


def truth_counts(findings: DataFrame, known: DataFrame) -> DataFrame:
    """gid, hits, first_match: how many findings mean each known one that any does, as `truth` says, and the least of them.

    Findings that say the same meet known ones that say the same once, so their pairs are never made.
    """
    found, _ = _alike(findings, "f")
    asked, members = _alike(known, "gid")
    met = truth(found.select("f", "n", F.inline("said")), asked.select("gid", F.inline("said")), "n")
    counts = met.groupBy("gid").agg(F.sum("n").alias("hits"), F.min("f").alias("first_match"))
    said = counts.join(asked.select("gid", "said"), "gid").select("said", "hits", "first_match")
    return members.join(said, "said").select("gid", "hits", "first_match")


def upgrades(rated: DataFrame) -> DataFrame:
    """n, correct, upgrade_precision, upgrade_recall of rated(raw, truth, guess) severities: one row.

    An upgrade is a severity that differs from the raw one; without any, precision and recall are 1.
    """
    due, done = F.col("raw") != F.col("truth"), F.col("raw") != F.col("guess")
    counts = rated.agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("guess")).alias("correct"), F.count_if(due).alias("due"), F.count_if(done).alias("done"), F.count_if(due & done).alias("both"))
    rate = lambda a: F.coalesce(F.expr(f"try_divide(both, {a})"), F.lit(1.0))
    return counts.select("n", "correct", rate("done").alias("upgrade_precision"), rate("due").alias("upgrade_recall"))

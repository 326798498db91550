"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditional expressions.

Only DataFrame operations touch the rows. Thresholds are chosen among the quantiles of every feature within the good and
within the bad rows, from bounded sketches. All labelled rows are counted into cells (bin of every feature, grow or prune half),
which stay a table on the cluster. A step of growing asks it for one histogram of good and bad rows by feature and bin, within
what the rule covers so far; pruning asks for the counts of each shortened rule. So the driver holds at most a row for each
feature and bin, whatever the number of rows and of cells that occur.

Defined cases: a null or empty text has no words and zero counts, so it fails the base rule. Repeated rows give repeated
rows. Rows without a label, or with a null label, are not learned from; an id with both labels counts as low quality. Without labelled rows of both classes the list is
empty and only the base rule decides. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bind, drop_table, materialise

#: Name -> expression over the statistics; compared after rounding to three digits.
FEATURES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "distinct_rate": "n_distinct_words / greatest(n_words, 1)",
    "shout_rate": "n_shouts / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "n_words": "n_words",
}
QUANTILES = (0.02, 0.1, 0.5, 0.9, 0.98)
WINDOW = 8


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; hashes: one for each window, in order."""

    def covered(pairs: Column) -> Column:
        # pairs: (hash, position) sorted; a window is repeated if a neighbour has its hash.
        hit = F.filter(pairs, lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | (F.get(pairs, i + 1)["h"] == x["h"]))
        return bind(
            F.sort_array(F.transform(hit, lambda x: x["p"])),
            lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"]),
        )

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(pairs, covered))

    return bind(hashes, count)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(words: Column) -> Column:
        windows = F.when(
            F.size(words) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>"))
        return F.struct(F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct_words"), _repeated_words(windows).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    counted = bind(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
    found = docs.select(
        "doc_id",
        bind(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), counts).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
        counted.alias("lines"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).alias("n_shouts"),
    )
    return found.select("doc_id", *[F.col(f"w.{c}").cast("long").alias(c) for c in ("n_words", "n_distinct_words", "n_repeat_words")], (F.col("lines.all") - F.col("lines.distinct")).cast("long").alias("n_dup_lines"), F.col("lines.all").cast("long").alias("n_lines"), *[F.col(c).cast("long") for c in ("word_chars", "n_symbols", "n_shouts")])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def feature(name: str) -> Column:
    return F.round(F.expr(FEATURES[name]), 3)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold); rows that meet it are of low quality."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        met = F.lit(True)
        for name, above, cut in self.conditions:
            met = met & ((feature(name) > cut) if above else (feature(name) <= cut))
        return met

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if up else '<='} {c:g}" for n, up, c in self.conditions)


def learn(labelled: DataFrame, most_rules: int = 8, most_conditions: int = 4, least_precision: float = 0.9, least_rows: int = 5) -> list[Rule]:
    """Sequential covering over labelled statistics; labelled: text_statistics columns and bad (boolean)."""
    names = list(FEATURES)
    quantiles = ", ".join(map(str, QUANTILES))
    per_class = labelled.select("bad", *[feature(n).alias(f"f_{n}") for n in names]).groupBy("bad").agg(*[F.expr(f"percentile_approx(f_{n}, array({quantiles}), 10000)").alias(n) for n in names]).collect()
    cuts = {n: sorted({round(float(c), 3) for r in per_class for c in r[n] or ()}) for n in names}
    bins = [sum((F.when(feature(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias(n) for n in names]
    half = (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(3)) > 0).alias("grow")
    cells = materialise(labelled.select(half, *bins, F.col("bad").cast("long").alias("bad")).groupBy("grow", *names).agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")))

    def meets(literal: tuple[str, bool, int]) -> Column:
        name, above, j = literal
        return (F.col(name) > j) == F.lit(above)

    def all_met(conditions) -> Column:
        met = F.lit(True)
        for literal in conditions:
            met = met & meets(literal)
        return met

    def histograms(inside: DataFrame) -> tuple[dict[str, list[list[int]]], int, int]:
        """Bad and good rows by feature and bin, and of all."""
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in names]))
        found = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
        for r in inside.select(each.alias("at"), "p", "n").groupBy("at").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect():
            found[r.at.feature][r.at.bin] = [r.p, r.n]
        return found, sum(c[0] for c in found[names[0]]), sum(c[1] for c in found[names[0]])

    def best_literal(inside: DataFrame) -> tuple[str, bool, int] | None:
        """The condition of largest gain in information over the bad rows, the first of equals; None if none gains."""
        found, p0, n0 = histograms(inside)
        best, most = None, 1e-9
        if not p0 or not n0:
            return None
        before = math.log2(p0 / (p0 + n0))
        for name in names:
            below_p = below_n = 0
            for j in range(len(cuts[name])):
                below_p, below_n = below_p + found[name][j][0], below_n + found[name][j][1]
                for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                    if p and (gain := p * (math.log2(p / (p + n)) - before)) > most:
                        best, most = (name, above, j), gain
        return best

    rules: list[Rule] = []
    left = cells
    while len(rules) < most_rules:
        chosen: list[tuple[str, bool, int]] = []
        while len(chosen) < most_conditions and (literal := best_literal(left.where("grow").where(all_met(chosen)))) is not None:
            chosen.append(literal)
        if not chosen:
            break
        # For each length of the rule: bad and good rows of the prune half, and bad ones of the grow half.
        sums = []
        for size in range(1, len(chosen) + 1):
            inside = all_met(chosen[:size])
            for name, which in (("p", ~F.col("grow")), ("n", ~F.col("grow")), ("p", F.col("grow"))):
                sums.append(F.coalesce(F.sum(F.when(inside & which, F.col(name))), F.lit(0)))
        got = list(left.agg(*[c.alias(f"c{k}") for k, c in enumerate(sums)]).first())
        counts = [tuple(got[3 * k : 3 * k + 3]) for k in range(len(chosen))]
        size = max(range(1, len(chosen) + 1), key=lambda k: ((counts[k - 1][0] - counts[k - 1][1]) / (counts[k - 1][0] + counts[k - 1][1]) if counts[k - 1][0] + counts[k - 1][1] else -1.0, -k))
        p, n, grown = counts[size - 1]
        if p + n == 0 or p / (p + n) < least_precision or p + grown < least_rows:
            break
        rules.append(Rule(tuple((name, above, cuts[name][j]) for name, above, j in chosen[:size])))
        left = left.where(~all_met(chosen[:size]))
    drop_table(cells)
    return rules


def decide(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (the first rule met, else null) and kept."""
    rule = F.lit(None).cast("string")
    for r in reversed(rules):
        rule = F.when(r.column(), F.lit(str(r))).otherwise(rule)
    return stats.withColumns({"base_failed": base_failed(), "rule": rule}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics, rule and verdict of every document; labels: doc_id, quality (1 good, 0 bad)."""
    stats = materialise(text_statistics(docs.select("doc_id", "text")))
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = materialise(stats.join(known, "doc_id").withColumn("bad", F.col("quality") == 0))
    return decide(stats, learn(labelled, **options))

"""Quality rules: learned decision lists over text statistics.

Sequential covering, one rule at a time: a conjunction of thresholds is *grown* on
two thirds of the labelled rows that no earlier rule covers (FOIL's information
gain picks each condition) and *pruned* on the other third (conditions are cut from the end while
precision does not fall). A rule enters the list only if it is precise enough on
the rows it was not grown on. The list is a Spark ``CASE WHEN`` in rule order, so
scoring is one pass over the text with no shuffle and no Python.

The learner sees at most ``max_rows`` labelled rows, those with the smallest hash of
their id, so what reaches the driver is bounded whatever the corpus holds.

Defined results: a null text has no words and fails the base rules; an unlabelled
corpus gives the empty list, which keeps every row; rows are scored one by one, so
repeated rows and ties get equal verdicts; null labels are not learned from; extra
columns of the input pass through ``QualityRules.score`` and are overwritten only where
they carry the name of a statistic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, table, words_of

#: Counted as symbols.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Statistics the rules may test, each scale-free so that thresholds hold for any length.
FEATURES = (
    "mean_word_chars",
    "symbols_per_word",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "upper_share",
    "bang_per_word",
    "digit_share",
    "words_per_line",
)


def _deleted(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and FEATURES.

    n_repeat_words: words in 8-word windows found twice or more in the text, the first
    included. Windows are compared by a 64-bit hash within one text. Most texts repeat
    no window, which a hash set tells; only the others sort their windows.
    Each step is a column of its own, so that no lambda evaluates an earlier step again.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.size("_words")
    df = docs.withColumns({"_words": words_of(F.col(text)), "_lines": F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))})
    df = df.withColumn(
        "_hashes",
        F.when(size >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(size - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        "_tagged",
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda x, at: F.coalesce(F.get("_tagged", at)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_starts", F.sort_array(F.transform(F.filter("_tagged", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    df = df.withColumns(
        {
            "n_words": size.cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
            "n_symbols": _deleted(t, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_n_lines": F.size("_lines"),
            "_n_distinct": F.size(F.array_distinct("_words")),
            "_n_upper": _deleted(t, "[A-Z]"),
            "_n_bang": _deleted(t, "!"),
            "_n_digit": _deleted(t, "[0-9]"),
        }
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    df = df.withColumns(
        {
            "mean_word_chars": per("word_chars", "n_words"),
            "symbols_per_word": per("n_symbols", "n_words"),
            "dup_line_share": per("n_dup_lines", "_n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"),
            "distinct_share": per("_n_distinct", "n_words"),
            "upper_share": per("_n_upper", "word_chars"),
            "bang_per_word": per("_n_bang", "n_words"),
            "digit_share": per("_n_digit", "word_chars"),
            "words_per_line": per("n_words", "_n_lines"),
        }
    )
    return df.drop("_words", "_lines", "_hashes", "_tagged", "_starts", "_n_lines", "_n_distinct", "_n_upper", "_n_bang", "_n_digit")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


class QualityRules:
    """An ordered list of rules that reject; what no rule covers is kept."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    def rule_index(self) -> Column:
        """1 for the first rule of the list that holds, 2 for the second, ...; 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), k) if out is None else out.when(rule.column(), k)
        return F.lit(0) if out is None else out.otherwise(0)

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with their statistics, base_failed, rule (0: none) and kept."""
        df = with_stats(docs, text).withColumn("base_failed", base_failed())
        df = df.withColumn("rule", self.rule_index())
        return df.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))

    def __str__(self) -> str:
        return "\n".join(f"if {r}: reject  (precision {r.precision:.3f})" for r in self.rules) or "keep all"


def _best_condition(rows: list[dict]) -> Condition | None:
    """The condition with the largest FOIL gain over rows; each feature is sorted once."""
    p0 = sum(r["bad"] for r in rows)
    if not p0 or p0 == len(rows):
        return None
    before, best, gain = math.log2(p0 / len(rows)), None, 1e-9
    for f in FEATURES:
        ordered = sorted(((r[f], r["bad"]) for r in rows), key=lambda x: x[0])
        p = n = 0
        for (v, bad), (after, _) in zip(ordered, ordered[1:]):
            p, n = p + bad, n + 1
            if after == v:
                continue
            cut = v + (after - v) / 2
            for above, pos, num in ((False, p, n), (True, p0 - p, len(rows) - n)):
                if pos and (g := pos * (math.log2(pos / num) - before)) > gain:
                    best, gain = Condition(f, above, cut), g
    return best


def _precision(conditions: tuple[Condition, ...], rows: list[dict]) -> tuple[float, int]:
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in conditions)]
    return (sum(hit) + 1) / (len(hit) + 2), sum(hit)


def learn(rows: list[dict], max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.85) -> QualityRules:
    """Sequential covering over labelled statistics; rows need FEATURES, ``bad`` (0 or 1) and ``prune`` (bool)."""
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grow, prune = [r for r in left if not r["prune"]], [r for r in left if r["prune"]]
        conditions: tuple[Condition, ...] = ()
        covered = grow
        while len(conditions) < max_conditions and (c := _best_condition(covered)):
            conditions, covered = (*conditions, c), [r for r in covered if c.holds(r)]
        if not conditions:
            break
        cuts = [conditions[:k] for k in range(1, len(conditions) + 1)]
        best = max(cuts, key=lambda c: (_precision(c, prune)[0], -len(c)))
        sure, hits = _precision(best, prune)
        if sure < min_precision or not hits:
            break
        rules.append(Rule(best, sure))
        left = [r for r in left if not rules[-1].holds(r)]
    return QualityRules(rules)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, **options) -> QualityRules:
    """Learn the list from labels (doc_id, quality 0 or 1); at most max_rows labelled rows are read.

    The rows with the smallest hashes of doc_id are taken. Rows that fail the base
    rules teach nothing new and are left out. A doc_id labelled more than once counts as its worst label; of
    different texts with one doc_id the one with the smallest hash is taken.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows bounds what is broadcast
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # max_rows rows at most
    stats = with_stats(texts).select("doc_id", "quality", "n_words", "n_repeat_words", *FEATURES).withColumn("third", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("prune")), F.lit(3)))
    # the base rules are applied here, as a filter would compute every statistic twice
    rows = [
        {f: float(r[f]) for f in FEATURES} | {"bad": int(r["quality"] == 0), "prune": r["third"] == 0}
        for r in sorted(stats.collect(), key=lambda r: r["doc_id"])
        if r["n_words"] >= 20 and 100 * r["n_repeat_words"] <= 30 * r["n_words"]
    ]
    return learn(rows, **options)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return rules.score(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")

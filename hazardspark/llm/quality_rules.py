"""Quality rules: a decision list learned by sequential covering.

The statistics are Spark expressions over whole texts. The list is learned from a
bounded sample of labelled statistics: a rule is a conjunction of thresholds, grown
by information gain on two thirds of the sample, pruned from its end on the other
third, and accepted only if it is precise there; the rows it covers are then set
aside and the next rule is sought. The result is an ordered ``CASE WHEN``.

Edge cases: a null or blank text has zero statistics and fails the base rule; a
document without a label or with a null label teaches nothing; without labels, or
with labels of one kind only, the list is empty and only the base rule decides;
a null ``doc_id`` is judged like any other. Repeated rows are judged each by itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hazardspark.llm.common import SPACE, count_matches, let, words

WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "distinct_rate", "digit_rate",
)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = stats[self.feature]
        return value <= F.lit(self.threshold) if self.at_most else value > F.lit(self.threshold)

    def holds(self, row: dict) -> bool:
        return row[self.feature] <= self.threshold if self.at_most else row[self.feature] > self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'<=' if self.at_most else '>'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered_words(hashes: Column) -> Column:
    """Positions inside windows whose hash occurs at least twice, as a word count."""

    def repeated(sorted_pairs: Column) -> Column:
        def is_repeat(pair: Column, at: Column) -> Column:
            before = F.get(sorted_pairs, at - 1)["h"] == pair["h"]
            after = F.get(sorted_pairs, at + 1)["h"] == pair["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        starts = F.array_sort(F.transform(F.filter(sorted_pairs, is_repeat), lambda p: p["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
            lambda acc, at: F.struct(
                (acc["words"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("words"), at.alias("last")
            ),
            lambda acc: acc["words"],
        )

    def pairs(hs: Column) -> Column:
        return F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    return let(
        hashes,
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(pairs(hs), repeated)),
    )


def _repeat_words(ws: Column) -> Column:
    n = F.size(ws)
    hashes = F.transform(
        F.sequence(F.lit(0), n - F.lit(WINDOW)),
        lambda i: F.xxhash64(*[F.get(ws, i + F.lit(k)) for k in range(WINDOW)]),
    )
    return F.when(n > WINDOW, _covered_words(hashes)).otherwise(F.lit(0))


def statistics(text: Column) -> Column:
    """The base counts and the features of a text, as one struct."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def counts(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            count_matches(body, r"#*$%&|<>").cast("long").alias("n_symbols"),
            let(lines, lambda ls: F.struct(
                F.size(ls).cast("long").alias("lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"),
            )).alias("l"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(ws)).cast("long").alias("distinct"),
            count_matches(body, r"\p{Lu}").cast("long").alias("upper"),
            count_matches(body, r"0-9").cast("long").alias("digits"),
        )

    def rates(c: Column) -> Column:
        n, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
        return F.struct(
            c["n_words"].alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["l"]["dup"].alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            (c["word_chars"] / n).alias("mean_word"),
            (c["n_symbols"] / n).alias("symbol_rate"),
            (c["l"]["dup"] / F.greatest(c["l"]["lines"], F.lit(1))).alias("dup_line_rate"),
            (c["n_repeat_words"] / n).alias("repeat_rate"),
            (c["upper"] / chars).alias("upper_rate"),
            (c["distinct"] / n).alias("distinct_rate"),
            (c["digits"] / chars).alias("digit_rate"),
        )

    return let(let(words(body), counts), rates)


def with_statistics(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_stats", statistics(F.col("text")))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (n_repeat_words * 100 > n_words * 20)


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Features and label of at most ``sample`` labelled documents, chosen by hash.

    Several labels of one document count as the lowest. The chosen labels are at
    most ``sample`` rows, which bounds the broadcast.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)
        .repartition(F.xxhash64("doc_id", "text"))
    )
    return with_statistics(texts).select("_quality", "_stats.*")


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    (p0, n0), (p1, n1) = before, after
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _counts(rows: list[tuple[dict, bool]]) -> tuple[int, int]:
    bad = sum(1 for _, is_bad in rows if is_bad)
    return bad, len(rows) - bad


def _grow(rows: list[tuple[dict, bool]], cuts: int, longest: int) -> Rule:
    rule: list[Condition] = []
    while len(rule) < longest and _counts(rows)[1] and _counts(rows)[0]:
        before, best, best_gain = _counts(rows), None, 1e-9
        for feature in FEATURES:
            ordered = sorted((row[feature], is_bad) for row, is_bad in rows)
            # Running counts at up to `cuts` distinct values; both directions are tried.
            step, p, n = max(1, len(ordered) // cuts), 0, 0
            for at, (value, is_bad) in enumerate(ordered[:-1]):
                p, n = p + is_bad, n + (not is_bad)
                following = ordered[at + 1][0]
                if following == value or (at % step and ordered[at + 1][1] == is_bad):
                    continue
                threshold = (value + following) / 2
                for at_most, after in ((True, (p, n)), (False, (before[0] - p, before[1] - n))):
                    if (gain := _gain(before, after)) > best_gain:
                        best, best_gain = Condition(feature, at_most, threshold), gain
        if best is None:
            break
        rule.append(best)
        rows = [x for x in rows if best.holds(x[0])]
    return tuple(rule)


def _covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _prune(rule: Rule, rows: list[tuple[dict, bool]]) -> Rule:
    def worth(r: Rule) -> float:
        p, n = _counts([x for x in rows if _covers(r, x[0])])
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(
    rows: list[tuple[dict, bool]], precision: float = 0.95, support: int = 3, cuts: int = 64,
    longest: int = 4, most_rules: int = 24,
) -> list[Rule]:
    """Ordered rejection rules from (features, is bad) rows.

    Every third row prunes, the others grow. A rule must reach ``precision`` on
    the growing and on all rows and cover at least ``support`` bad rows.
    """
    rest = list(rows)
    found: list[Rule] = []
    while len(found) < most_rules:
        growing, pruning = [x for k, x in enumerate(rest) if k % 3], rest[::3]
        if not growing or not all(_counts(growing)):
            break
        rule = _grow(growing, cuts, longest)
        if not rule:
            break
        pruned = _prune(rule, pruning)
        for candidate in (pruned, rule):
            p, n = _counts([x for x in rest if _covers(candidate, x[0])])
            if p >= support and p >= precision * (p + n):
                break
        else:
            break
        found.append(candidate)
        rest = [x for x in rest if not _covers(candidate, x[0])]
    return found


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, precision: float = 0.95) -> list[Rule]:
    """Learn the list from at most ``sample`` labelled documents that pass the base rule."""
    stats = labelled_statistics(docs, labels, sample)
    stats = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    ordered = stats.select("_quality", *FEATURES).collect()
    rows = sorted(((r.asDict(), r["_quality"] == 0) for r in ordered), key=lambda x: _mixed(x[0]))
    return learn(rows, precision)


def _mixed(row: dict) -> tuple:
    """An order that depends on the values alone, so that every run splits alike."""
    return (hash(tuple(row[f] for f in FEATURES)), tuple(row[f] for f in FEATURES), row["_quality"])


def verdict(rules: list[Rule], stats: Column) -> Column:
    """0 if no rule holds, else the position of the first that does."""
    out = F.lit(0)
    for position, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column(stats)
        out = F.when(holds, F.lit(position)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``_stats``, ``base_failed``, ``rule`` (0: none) and ``kept``."""
    names = dict.fromkeys((*BASE, *FEATURES))

    def judged(s: Column) -> Column:
        failed = base_failed(s["n_words"], s["n_repeat_words"]).alias("base_failed")
        return F.struct(*[s[n].alias(n) for n in names], failed, verdict(rules, s).alias("rule"))

    out = docs.withColumn("_stats", let(statistics(F.col("text")), judged))
    failed, rule = F.col("_stats.base_failed"), F.col("_stats.rule")
    return out.withColumns({"base_failed": failed, "rule": rule, "kept": ~failed & (rule == 0)})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Only the documents that pass, with their own columns."""
    rules = fit(docs, labels)

    def passes(s: Column) -> Column:
        return ~base_failed(s["n_words"], s["n_repeat_words"]) & (verdict(rules, s) == 0)

    # One expression, so that the filter computes the statistics once.
    return docs.where(let(statistics(F.col("text")), passes))

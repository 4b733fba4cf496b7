"""Quality rules: base statistics in Spark expressions, and a learned decision list.

Statistics are DataFrame functions over the whole text. Words are
`[^\\x20\\x09-\\x0D]+`. A word counts as repeated if it lies in a
three-word window that is found twice or more in the text. Windows are compared by
64-bit hashes; only texts in which one comes again have them sorted.

The decision list is learnt by sequential covering from a bounded sample of
labelled statistics (`fit_rows`, those of least id hash): a rule grows one
threshold at a time by information gain on two thirds of the sample and is then pruned on
the rest, dropping last conditions while that doesn't lower its precision there.
Rules of precision `precision` and over are kept, what they cover is
taken out, and the next is grown. The list comes out as one SQL CASE: the
first rule that holds rejects a document, and if none does it is kept.

Null texts count as empty: no words, base_failed. Null labels and
labels without a document aren't learnt from; without any the list is
empty and keeps all that pass the base rules. Rows that repeat a doc_id are
judged one by one. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import sampled, saved

FIT_ROWS = 20_000
PRECISION, MOST_RULES, MOST_CONDITIONS, THRESHOLDS = 0.97, 12, 3, 24
#: What rules may ask of a document, from its statistics.
FEATURES = {
    "n_words": "n_words",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclamations_per_word": "n_exclamations / greatest(n_words, 1)",
    "kind_share": "n_kinds / greatest(n_words, 1)",
}
_SPACE = "\t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash comes twice, given the hash of the window from each word."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("total"))
        step = lambda a, x: F.struct(x.alias("last"), (a.total + F.least(F.lit(3), x - a.last)).alias("total"))
        return F.aggregate(places, start, step, lambda a: a.total)

    def again(pairs: Column) -> Column:
        near = lambda e, k, d: F.coalesce(F.get(pairs, k + d).h == e.h, F.lit(False))
        twice = F.filter(pairs, lambda e, k: near(e, k, -1) | near(e, k, 1))
        return covered(F.sort_array(F.transform(twice, lambda e: e.at)))

    pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(_let(pairs, again))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, _SPACE, " " * len(_SPACE)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, _SPACE + " ", "")) > 0)

    def windows(w: Column) -> Column:
        three = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), three))

    of_words = _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_kinds"), _let(windows(w), _repeated).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), of_words.alias("_w"), of_lines.alias("_l"),
        F.length(F.translate(text, _SPACE + " ", "")).cast("bigint").alias("word_chars"),
        _count(text, "#*$%&|<>").alias("n_symbols"), _count(text, "!").alias("n_exclamations"), _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
    ).select("doc_id", "_w.*", "word_chars", "n_symbols", "_l.*", "n_exclamations", "n_upper")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Rule = list[tuple[str, str, float]]


def _holds(row: dict, rule: Rule) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in rule)


def _entropy_gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grown(rows: list[dict]) -> Rule:
    rule: Rule = []
    while len(rule) < MOST_CONDITIONS:
        p0 = sum(r["bad"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, most = None, 1e-9
        for f in FEATURES:
            values = sorted(r[f] for r in rows)
            bad = sorted(r[f] for r in rows if r["bad"])
            cuts = sorted({v[len(v) * k // THRESHOLDS] for v in (values, bad) for k in range(1, THRESHOLDS)} | {values[0], values[-1]})
            for t in cuts:
                p = sum(r["bad"] for r in rows if r[f] <= t)
                n = sum(1 for r in rows if r[f] <= t) - p
                for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                    gain = _entropy_gain(p0, n0, pp, nn)
                    if gain > most:
                        best, most = (f, op, t), gain
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if _holds(r, [best])]
    return rule


def _worth(rows: list[dict], rule: Rule) -> tuple[float, int]:
    """(precision by Laplace's rule, bad rows covered)."""
    covered = [r["bad"] for r in rows if _holds(r, rule)]
    return (sum(covered) + 1) / (len(covered) + 2), sum(covered)


def _pruned(rows: list[dict], rule: Rule) -> Rule:
    while len(rule) > 1 and _worth(rows, rule[:-1])[0] >= _worth(rows, rule)[0]:
        rule = rule[:-1]
    return rule


def learn(rows: list[dict], precision: float = PRECISION) -> list[Rule]:
    """An ordered list of rules for `bad` rows (features, bad 0/1), rows of a bounded sample."""
    grow = [r for k, r in enumerate(rows) if k % 3]
    prune = [r for k, r in enumerate(rows) if not k % 3]
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        rule = _pruned(prune, _grown(grow))
        if not rule:
            break
        value, found = _worth(prune, rule)
        own, _ = _worth(grow, rule)
        if value < min(precision, 1 - 1 / (found + 2) + 1e-9) or own < precision or not found:
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not _holds(r, rule)] for part in (grow, prune))
    return rules


def as_case(rules: list[Rule]) -> str:
    """The list as a SQL CASE that is true for documents to keep."""
    if not rules:
        return "true"
    when = [" AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in rule) for rule in rules]
    return "CASE " + " ".join(f"WHEN {w} THEN false" for w in when) + " ELSE true END"


def judged(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, precision: float = PRECISION) -> DataFrame:
    """Statistics of every document, base_failed, kept, and the list that decided (rules)."""
    stats = saved(statistics(docs), "statistics")
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = stats.join(good, "doc_id").where(~base_failed())
    rows = sampled(known, F.xxhash64("doc_id"), fit_rows).select(*(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()), (F.col("quality") == 0).cast("int").alias("bad")).collect()
    case = as_case(learn([r.asDict() for r in rows], precision))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.expr(case)).withColumn("rules", F.lit(case))

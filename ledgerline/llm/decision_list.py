"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of each text are native expressions. Sequential covering learns which conjunctions of thresholds mark bad
texts: a rule grows by the condition with the best information gain, is pruned on rows held back from growing, and the
rows that it covers are set aside before the next rule. Each step is one Spark aggregate over binned statistics; only
counts per statistic and bin reach the driver. The list becomes ordered WHEN conditions.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged, texts

#: Statistics that rules may use; each is a ratio or a count of the columns of text_statistics().
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "calls_per_word": "n_calls / greatest(n_words, 1)",
}
_BLANK = r"[\x20\x09-\x0D]+"


def text_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_calls), a row per row.

    Words lie between ASCII white space; a null text has none. n_repeat_words counts words in 3-word windows that occur
    twice or more: windows' 64-bit hashes are sorted with their places, and neighbours compared.
    """
    docs = texts(documents).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    docs = docs.withColumn("w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK)))
    docs = docs.withColumn("lines", F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    docs = docs.select(
        "doc_id", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"), F.regexp_count("text", F.lit("!")).alias("n_calls"),
        F.expr("case when size(w) < 4 then cast(array() as array<bigint>) else transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) end").alias("h"),
    )
    packed = F.expr("case when size(array_distinct(h)) = size(h) then cast(array() as array<struct<x: bigint, i: int>>) else sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i))) end")
    docs = docs.withColumn("p", packed)
    twice = "(k > 0 and p[k].x = p[k - 1].x) or (k < size(p) - 1 and p[k].x = p[k + 1].x)"
    docs = docs.withColumn("d", F.expr(f"case when size(p) = 0 then cast(array() as array<int>) else sort_array(transform(filter(sequence(0, size(p) - 1), k -> {twice}), k -> p[k].i)) end"))
    repeated = F.expr("aggregate(d, named_struct('last', -3, 'n', 0), (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n)")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_calls"]
    return docs.withColumn("n_repeat_words", repeated).select("doc_id", *(F.col(c).cast("long").alias(c) for c in names))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def binned(self, cuts: dict[str, list[float]]) -> Column:
        at = cuts[self.feature].index(self.threshold)
        return F.col(self.feature) > at if self.above else F.col(self.feature) <= at


Rule = tuple[Condition, ...]


def _below(value: Column):
    return lambda cut: cut < value


def _all(rule: Rule, cuts: dict) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.binned(cuts)
    return out


def _best(rows: DataFrame, cuts: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition | None]:
    """The condition with the largest FOIL gain over rows, from counts per statistic and bin."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES)))
    counts = rows.select("bad", pairs.alias("e")).groupBy("e.f", "e.b").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
    best: tuple[float, Condition | None] = (0.0, None)
    for f in FEATURES:
        own = sorted((r.b, int(r.p), int(r.n - r.p)) for r in counts if r.f == f)
        p = n = 0
        for b, dp, dn in own[:-1] if own else ():
            p, n = p + dp, n + dn
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                if pp and b < len(cuts[f]):
                    gain = pp * (log2(pp / (pp + nn)) - log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(f, above, cuts[f][b]))
    return best


def learn(labelled: DataFrame, bad: str = "bad", most_rules: int = 8, most_conditions: int = 3, bins: int = 64, precision: float = 0.9, least_rows: int = 8, sample: int = 200_000) -> list[Rule]:
    """Rules for rows with bad = 1, best first, from `labelled` (text statistics and `bad`).

    At most `sample` labelled rows are used, by the order of their statistics' hash. Rows with a null label are left out.
    A rule must keep `precision` on the third of the rows held back and cover `least_rows` rows. No labelled rows, or
    rows of one kind only, give no rules.
    """
    rows = labelled.where(F.col(bad).isNotNull()).select(F.col(bad).cast("int").alias("bad"), *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()))
    rows = rows.withColumn("h", F.xxhash64("bad", *FEATURES))
    rows = staged(rows.orderBy("h").limit(sample), "labelled")
    marks = [i / bins for i in range(1, bins)]
    found = rows.where("bad = 1").agg(*(F.percentile_approx(f, marks, 10_000).alias(f) for f in FEATURES)).first()
    other = rows.agg(*(F.percentile_approx(f, marks, 10_000).alias(f) for f in FEATURES)).first()
    if other[0] is None or found[0] is None:
        return []
    cuts = {f: sorted({*found[f], *other[f]}) for f in FEATURES}
    binned = [F.size(F.filter(F.lit(c), _below(F.col(f)))).alias(f) for f, c in cuts.items()]
    rows = staged(rows.select("bad", (F.pmod("h", F.lit(3)) == 0).alias("held"), *binned), "binned")
    rules: list[Rule] = []
    while len(rules) < most_rules:
        covered = F.lit(False)
        for r in rules:
            covered = covered | _all(r, cuts)
        left = rows.where(~covered)
        grow, rule = left.where("not held"), ()
        while len(rule) < most_conditions:
            now = grow.where(_all(rule, cuts))
            n, p = now.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
            if not p or p == n:
                break
            _, condition = _best(now, cuts, p, n - p)
            if condition is None:
                break
            rule = (*rule, condition)
        if not rule:
            break
        heads = [rule[: i + 1] for i in range(len(rule))]
        held = left.where("held").agg(*(x for r in heads for x in (F.count_if(_all(r, cuts)), F.coalesce(F.sum(F.when(_all(r, cuts), F.col("bad"))), F.lit(0))))).first()
        score = [(2 * held[2 * i + 1] - held[2 * i]) / max(held[2 * i], 1) for i in range(len(heads))]
        i = max(range(len(heads)), key=lambda i: (score[i], -i))
        if held[2 * i] < least_rows / 3 or held[2 * i + 1] < precision * held[2 * i]:
            break
        rules.append(heads[i])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """keep: False where a rule holds, in order, else True."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row per row of `documents`.

    `labels` has doc_id and quality (0 bad, 1 good); rows without either are left out, and a doc_id labelled twice
    counts as bad if one label says so. A null or empty text fails the base rule (under 50 words). Null and repeated
    doc_ids pass through. Other columns are ignored; without usable labels only the base rule decides; an empty table
    gives an empty one.
    """
    stats = staged(text_statistics(documents), "statistics")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).alias("bad"))
    rules = learn(stats.where(~base).join(known, "doc_id"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return stats.select(*names, base.alias("base_failed"), (~base & verdict(rules)).alias("kept"))

"""Learned quality rules: an ordered list of threshold conjunctions, given as one Spark conditional expression.

Sequential covering on labelled statistics. Features become bin numbers by quantiles; the labelled rows are summed up to
counts of good and bad per combination of bins and fold, once. A rule grows literal by literal (``feature > t`` or
``feature <= t``) by information gain on the growing fold, is cut back to the prefix that does best on the pruning fold,
and is taken if its share of bad rows there is high enough; rows it covers leave, and the next rule follows. Each step
is one aggregation that returns a number per feature and bin.

Everything is DataFrame functions; the driver sees sums only. Labelled rows are a sample bounded by ``max_rows``
(expected size; rows are taken by the hash of their id), everything else covers all rows.

Cases: a null or empty text has no words, all counts are 0 and it fails the base. Rows with equal id are judged each by
its own text. Labels that are null or contradict each other for an id are left out; without labels of both kinds there
are no rules. An empty table gives an empty one. Columns of the input are not read by name except id and text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, hash_share, store

WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8
MAX_ROWS = 20_000

RATIOS = {  # what rules may speak about
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "mean_word": ("word_chars", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_word_lines"),
    "words_per_line": ("n_words", "n_word_lines"),
}


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float
    bin: int

    def holds(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def holds_bin(self) -> Column:
        return F.col(self.feature) > self.bin if self.above else F.col(self.feature) <= self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


def text_statistics(df: DataFrame, text: str = "text", drop: bool = True) -> DataFrame:
    """Adds the counts rules are made of; a window that is found twice is known by its 64-bit hash inside one text."""
    t = F.coalesce(F.col(text), F.lit(""))
    stripped = F.btrim(t, F.lit(WHITE))
    word_lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = df.withColumns({
        "_words": F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, "[ \\t-\\r]+")),
        "_lines": word_lines,
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count(t, F.lit("\\p{Lu}")).cast("long"),
        "n_digits": F.regexp_count(t, F.lit("[0-9]")).cast("long"),
        "n_marks": F.regexp_count(t, F.lit("[!?]")).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_word_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    df = df.withColumns({
        "n_distinct_words": F.size(F.array_distinct("_hashes")).cast("long"),
        "_windows": F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW))))),
    })
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    no = F.lit(False)
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda x, j: (
        F.coalesce(F.get("_sorted", j + 1)["h"] == x["h"], no) | F.coalesce(F.get("_sorted", j - 1)["h"] == x["h"], no)
    )), lambda x: x["i"])))
    width = F.lit(WINDOW)
    covered = F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at"), F.lit(0))),
                         lambda a, b: F.least(width, F.coalesce(b - a, width)))
    df = df.withColumn("n_repeat_words", F.coalesce(
        F.when(F.size("_at") > 0, F.aggregate(covered, F.lit(0), lambda s, x: s + x)), F.lit(0)).cast("long"))
    # A condition on a statistic must not be moved below it, where it would be spelled out, and computed, many times
    # over: a number that is no function of the row stands in its way.
    df = df.withColumn("_no", F.monotonically_increasing_id())
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_no") >= 0, F.col("n_repeat_words")), F.lit(0).cast("long")))
    return df.drop("_no", "_lines", "_words", "_hashes", "_windows", "_sorted", "_at", *([text] if drop else []))


def ratios(df: DataFrame) -> DataFrame:
    """Adds the features of ``RATIOS``; a ratio to nothing is 0."""
    return df.withColumns({k: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)) for k, (a, b) in RATIOS.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn_rules(rows: DataFrame, features: list[str], bins: int = 32, max_rules: int = 12, max_literals: int = 4,
                min_precision: float = 0.9, min_bad: int = 5) -> list[list[Literal]]:
    """Rules for ``bad`` rows. ``rows``: double features, ``bad`` boolean and ``fold`` (0 prunes, others grow)."""
    wanted = [(i + 1) / bins for i in range(bins - 1)]
    found = rows.agg(*(F.percentile_approx(f, wanted, 10_000).alias(f) for f in features)).first()
    values = {f: sorted(set(found[f] or ())) for f in features}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}
    # a bin's number is how many cuts lie below the value: value > cuts[b] exactly if bin > b
    binned = rows.select(((F.col("fold") == 0).alias("_prune")), "bad", *(
        sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in features))
    stats = store(binned.groupBy("_prune", *features).agg(
        F.count_if("bad").alias("_p"), F.count_if(~F.col("bad")).alias("_n")), "rule-statistics")

    def counts(left: Column, rule: list[Literal]):
        """Good and bad per feature and bin on the growing fold, among rows the rule covers."""
        here = stats.where(~F.col("_prune") & left)
        for x in rule:
            here = here.where(x.holds_bin())
        long = here.select("_p", "_n", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f).alias("b")) for i, f in enumerate(features)))).alias("x"))
        out = {}
        for r in long.groupBy("x.f", "x.b").agg(F.sum("_p").alias("p"), F.sum("_n").alias("n")).collect():
            out.setdefault(features[r["f"]], {})[r["b"]] = (r["p"], r["n"])
        return out

    rules, left = [], F.lit(True)
    while len(rules) < max_rules:
        rule: list[Literal] = []
        while len(rule) < max_literals:
            have = counts(left, rule)
            total = next(iter(have.values()), {})
            p0, n0 = (sum(x[i] for x in total.values()) for i in (0, 1))
            if p0 < min_bad or n0 == 0:
                break
            best = (0.0, "", 0, None)
            for f, by_bin in sorted(have.items()):
                p = n = 0
                for b, cut in enumerate(cuts[f]):
                    p, n = p + by_bin.get(b, (0, 0))[0], n + by_bin.get(b, (0, 0))[1]
                    for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                        if q >= min_bad and (g := _gain(p0, n0, q, m)) > best[0] + 1e-9:
                            best = (g, f, b, Literal(f, above, cut, b))
            if best[3] is None:
                break
            rule.append(best[3])
        if not rule:
            break
        prefix, sums = F.lit(True), []
        for i, x in enumerate(rule):
            prefix = prefix & x.holds_bin()
            sums += [F.sum(F.when(prefix, F.col(c))).alias(f"{c}{i}") for c in ("_p", "_n")]
        on = stats.where(F.col("_prune") & left).agg(*sums).first()
        scored = [((p - n) / (p + n), i, p / (p + n)) for i in range(len(rule)) if (p := on[f"_p{i}"] or 0) + (n := on[f"_n{i}"] or 0)]
        if not scored:
            break
        _, size, precision = max(scored, key=lambda s: (s[0], -s[1]))
        if precision < min_precision:
            break
        rules.append(rule[: size + 1])
        covers = F.lit(True)
        for x in rules[-1]:
            covers = covers & x.holds_bin()
        left = left & ~covers
    discard(stats)
    return rules


def rule_number(rules: list[list[Literal]]) -> Column:
    """Number of the first rule that covers a row, from 1; 0 if none does."""
    out = None
    for number, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for x in rule:
            holds = holds & x.holds()
        out = F.when(holds, number) if out is None else out.when(holds, number)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[list[Literal]]:
    """Rules from texts whose ``quality`` label is 0 (bad) or 1."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("_low"), F.max("quality").alias("_high")).where("_low = _high")
    total = known.count()
    sample = known.where(hash_share(F.xxhash64("doc_id"), max_rows, total))
    if total and sample.isEmpty():
        raise ValueError("the sample of labels is empty though there are labels")
    sample = sample.select(F.col("doc_id").alias("_doc"), (F.col("_low") == 0).alias("bad"))
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "_doc")  # max_rows bounds it
    rows = ratios(text_statistics(rows)).where(~base_failed())
    rows = store(rows.select("bad", F.pmod(F.xxhash64("_doc", F.lit("fold")), F.lit(3)).alias("fold"), *RATIOS), "labelled-features")
    rules = learn_rules(rows, list(RATIOS))
    discard(rows)
    return rules


def judge(df: DataFrame, rules: list[list[Literal]], text_col: str = "text", drop: bool = True) -> DataFrame:
    """Adds the statistics, ``base_failed``, ``rule`` (0: none) and ``kept``."""
    out = ratios(text_statistics(df, text_col, drop)).withColumns({"base_failed": base_failed(), "rule": rule_number(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    rules = fit(docs, labels, max_rows, id_col, text_col)
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    return judge(docs.select(own, F.col(text_col).alias("text")), rules).where("kept").select("_row.*")

"""Quality rules learnt from labelled texts: an ordered list of threshold rules, in Spark's own expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts

#: The labelled rows that rules are learnt from, at most; those of lowest hash are taken.
MOST_LABELLED = 20_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: What rules may test: counts of the text, and shares that do not depend on its length.
TESTED = ("n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "distinct_share", "sign_share")


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares in
    ``TESTED``, per row of ``df``; only built-in functions, each row by itself.

    Repeated 3-word windows are found by sorting the windows' 64-bit hashes with their places
    and comparing neighbours, and only in texts in which some hash repeats.
    """
    t = texts(df, id_col, text_col)
    words = F.array_remove(F.split(F.translate("text", SPACES[1:], " " * 5), " "), "")
    bare = F.translate("text", SPACES, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    t = t.select(
        "doc_id", words.alias("w"), lines.alias("l"),
        F.length(bare).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("upper"),
        (F.length("text") - F.length(F.translate("text", "0123456789", ""))).alias("digits"),
        (F.length("text") - F.length(F.translate("text", "!?.,;:", ""))).alias("signs"),
    )
    grams = F.transform(
        F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
    )
    t = t.withColumn("g", grams)
    ranked = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some_repeat = F.size(F.array_distinct("g")) < F.size("g")
    t = t.withColumn("s", F.when(some_repeat, ranked)).drop("g")
    twice = F.filter(
        F.transform("s", lambda x, j: F.when((F.get("s", j - 1)["h"] == x["h"]) | (F.get("s", j + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("sum"))
    covered = F.aggregate(
        F.sort_array(twice), start,
        lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    n = F.size("w").cast("bigint")
    t = t.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("l").alias("n_lines"), F.size(F.array_distinct("w")).alias("n_distinct"), "upper", "digits", "signs",
    )

    def share(a: str, b: str) -> Column:
        return (F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(a)

    shares = [share("word_chars", "n_words").alias("mean_chars"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("upper", "word_chars").alias("upper_share"), share("digits", "word_chars").alias("digit_share"), share("n_distinct", "n_words").alias("distinct_share"), share("signs", "word_chars").alias("sign_share")]
    found = t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *shares)
    # a filter on what follows would otherwise be pushed below and work everything out anew in each of its terms
    return found.select(F.inline(F.array(F.struct("*"))))


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    bound: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.name] > self.bound if self.above else row[self.name] <= self.bound

    def column(self) -> Column:
        return F.col(self.name) > self.bound if self.above else F.col(self.name) <= self.bound


@dataclass(frozen=True)
class Rule:
    """Texts for which all ``tests`` hold are dropped."""

    tests: tuple[Test, ...]

    def holds(self, row: dict[str, float]) -> bool:
        return all(t.holds(row) for t in self.tests)

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out


def bounds_of(rows: list[dict[str, float]], name: str, most: int = 24) -> list[float]:
    """Midpoints between neighbouring values, thinned evenly over the rows."""
    values = sorted(r[name] for r in rows)
    cuts = {values[k * (len(values) - 1) // most] for k in range(1, most)} if len(values) > most else set(values)
    out = []
    for v in sorted(cuts):
        above = next((x for x in values if x > v), None)
        if above is not None:
            out.append((v + above) / 2)
    return out


def grown(bad: list[dict], good: list[dict]) -> Rule | None:
    """Test by test, what tells the bad rows best from the good ones, until no good one is
    covered or no test gains anything."""
    tests: list[Test] = []
    while bad and good and len(tests) < 4:
        before = math.log2(len(bad) / (len(bad) + len(good)))
        best, most = None, 0.0
        for name in TESTED:
            cuts = bounds_of(bad, name)
            for above in (True, False):
                for cut in cuts:
                    t = Test(name, above, cut)
                    p = sum(t.holds(r) for r in bad)
                    if not p:
                        continue
                    n = sum(t.holds(r) for r in good)
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > most + 1e-9:
                        best, most = t, gain
        if best is None:
            break
        tests.append(best)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return Rule(tuple(tests)) if tests else None


def pruned(rule: Rule, bad: list[dict], good: list[dict]) -> tuple[Rule, float]:
    """The rule cut back to the leading tests that do best on rows it was not grown on, and
    its precision there."""
    best, top = rule, (-2.0, 0.0)
    for k in range(len(rule.tests), 0, -1):
        r = Rule(rule.tests[:k])
        p, n = sum(map(r.holds, bad)), sum(map(r.holds, good))
        worth = ((p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0)
        if worth >= top:
            best, top = r, worth
    return best, top[1]


def cover(rows: list[tuple[dict[str, float], int]], precision: float = 0.9, most: int = 12) -> list[Rule]:
    """Sequential covering: a rule for bad rows (label 0) is grown on two thirds and pruned on
    the rest; the rows it covers are taken out, and so on until a rule is not precise enough."""
    third = [[r for i, r in enumerate(rows) if (i % 3 == 2) == late] for late in (False, True)]
    (bad, good), (bad_, good_) = [([x for x, y in part if not y], [x for x, y in part if y]) for part in third]
    rules: list[Rule] = []
    while bad and len(rules) < most:
        rule = grown(bad, good)
        if rule is None:
            break
        rule, right = pruned(rule, bad_, good_)
        if right < precision or sum(map(rule.holds, bad)) < 3:
            break
        rules.append(rule)
        bad, good, bad_, good_ = ([r for r in part if not rule.holds(r)] for part in (bad, good, bad_, good_))
    return rules


def learn_rules(df: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules from the rows of ``df`` that ``labels`` (doc_id, quality) marks: their statistics,
    of ``most`` rows at most, are what the driver sees. An id that ``labels`` marks both ways is left out."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    marked = marked.where("quality = other").drop("other")
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = texts(df, id_col, text_col).join(F.broadcast(some), "doc_id")
    rows = statistics(picked).join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), *TESTED).limit(most).collect()
    return cover([({k: r[k] for k in TESTED}, r["quality"]) for r in rows if not failed(r)])


def failed(r) -> bool:
    return r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]


def judge(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of each row of ``df``, base_failed, rule (the place of the first rule that
    holds, from 0, else null) and kept.

    Nulls: a null text has no words and so fails the base; a null id stays null. Texts are
    judged whole. Equal texts get equal verdicts. An empty table gives no rows. Other columns
    of ``df`` are not read. Without rules the base alone decides.
    """
    found = statistics(df, id_col, text_col)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    first = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        first = F.when(rules[k].column(), F.lit(k)).otherwise(first)
    return found.withColumn("base_failed", base).withColumn("rule", first).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())

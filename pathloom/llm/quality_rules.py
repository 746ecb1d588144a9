"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition that rejects a document.  The cascade estimates on a bounded sample
what each rule costs (the seconds of a job that evaluates it, less those of a job that reads the same
rows and evaluates nothing) and how many documents it rejects, orders the rules by
rejection per cost, and evaluates them as one CASE expression: a document that
an early rule rejects never pays for the later ones.  The order changes the work, never
the verdict.  Rules over the statistics that every row has to return cost a comparison; what
else a rule needs (a scan of the text or of its words) is its own cost and is worked out only for
the rows that reach it.

Defined results: a null text has no words; empty and wordless texts have zero counts and
fail the length rule; repeated rows are answered one by one; an empty table gives an empty
result with the rules in their given order; other columns are carried by
``with_statistics`` unless they bear a statistic's name, in which case they are replaced.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.plans.staging import discard, stage

#: White space of the words `[^\x20\x09-\x0D]+`.
BLANKS = " \t\n\x0b\x0c\r"
#: Words of a window, a power of two.
WINDOW = 8
SAMPLE_ROWS = 1000
#: Seconds that a rule costs at least on the sample: less is noise.
LEAST_SECONDS = 0.03
# Frequent words of the languages at hand.
STOPWORDS = (
    "the of and to in that is was for it with der die und den das ist von le la de et les des du est el los y que en un una ein a"
).split()
_BLANK = "[\\x20\\x09-\\x0D]"
#: A stop word in letters of either case, between blanks.
STOP_PATTERN = f"(?:^|{_BLANK})(?:{'|'.join(''.join(f'[{c}{c.upper()}]' for c in w) for w in STOPWORDS)})(?:{_BLANK}|$)"


class Rule(NamedTuple):
    name: str
    rejects: Column


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds words, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    unblanked = body
    for blank in BLANKS:
        unblanked = F.replace(unblanked, F.lit(blank), F.lit(""))
    df = docs.withColumns({"words": words, "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.char_length(unblanked).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_grams": F.transform("words", lambda w: F.xxhash64(w)),
        }
    )
    # Hashes of windows of 2, 4 and at last 8 words: those of two adjacent halves.
    half = 1
    while half < WINDOW:
        rest = F.greatest(F.size("_grams") - half, F.lit(0))
        both = F.zip_with(F.slice("_grams", F.lit(1), rest), F.slice("_grams", F.lit(half + 1), rest), lambda x, y: F.xxhash64(x, y))
        df, half = df.withColumn("_grams", both), 2 * half
    # Texts without a repeated window, nearly all, skip the sort.
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_grams")) < F.size("_grams"),
            F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    same = lambda x, k: F.get("_sorted", k)["h"] == x["h"]
    df = df.withColumn(
        "_at",
        F.array_sort(
            F.transform(
                F.filter(
                    "_sorted",
                    lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "_at",
        start,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", covered).drop("_lines", "_grams", "_sorted", "_at")


def base_rules() -> list[Rule]:
    """Rules whose thresholds are part of the contract."""
    return [
        Rule("short", F.col("n_words") < 20),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    ]


def production_rules(text: str = "text") -> list[Rule]:
    """Further rules over the statistics and the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(body, F.lit(pattern))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 10 * F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 16 * F.col("n_words"))),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("exclamations", 10 * count("!") > 3 * F.col("n_words")),
        Rule("capitals", 2 * count("[A-Z]") > F.col("word_chars")),
        Rule("variety", (F.col("n_words") >= 50) & (20 * F.size(F.array_distinct("words")) < F.col("n_words"))),
        Rule("digits", 2 * count("[0-9]") > F.col("word_chars")),
        Rule("letters", 10 * count("\\p{L}+") < 6 * F.col("n_words")),
        Rule("stop_words", ~body.rlike(STOP_PATTERN)),
        Rule("bullets", 10 * count("(?md)^[ \\t]*[-*•] ") > 9 * F.col("n_lines")),
        Rule("ellipses", 10 * count("(?md)(\\.\\.\\.|…)[ \\t\\r]*$") > 3 * F.col("n_lines")),
    ]


def cascade_order(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejection per cost on the sample; ties keep the given order.

    ``sample`` should be a stored table, else each timing pays for making it.
    """
    row = sample.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(r.rejects.cast("double")).alias(f"r{i}") for i, r in enumerate(rules)]
    ).first()
    if not row["n"]:
        return list(rules)

    def seconds(condition: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.count_if(condition)).collect()
        return time.perf_counter() - began

    idle = seconds(F.lit(True) if "words" not in sample.columns else F.size("words") >= 0)
    costs = [max(seconds(r.rejects) - idle, LEAST_SECONDS) for r in rules]
    worth = [(row[f"r{i}"] or 0.0) / cost for i, cost in enumerate(costs)]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -worth[i])]


def rejected(rules: list[Rule]) -> Column:
    """Whether any rule rejects, evaluated in the given order up to the first that does."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects, True) if out is None else out.when(rule.rejects, True)
    return F.lit(False) if out is None else out.otherwise(False)


def bounded_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, at most twice as many, for cost estimates only."""
    n = docs.count()
    return docs.sample(min(1.0, rows / max(n, 1)), seed=7).limit(2 * rows)


def quality_verdicts(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the statistics, base_failed and kept."""
    sample = stage(with_statistics(bounded_sample(docs.select(F.col(text)), sample_rows), text).coalesce(1), "rules")
    order = cascade_order(sample, base_rules() + production_rules(text))
    discard(sample)
    df = with_statistics(docs, text)
    return df.withColumns({"base_failed": rejected(base_rules()), "kept": ~rejected(order)})

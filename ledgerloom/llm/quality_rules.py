"""Quality rules as weak supervision, on DataFrame functions alone.

Each rule votes good (1), bad (0) or abstains (null) on measures of a document.
Expectation-maximisation over the table of vote patterns (at most 3 to the number of
rules, whatever the corpus size) estimates how far each rule can be trusted on good and
on bad documents, and the posterior probability of being good decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, squeezed, whole_text

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: EM runs until no estimate moves by CLOSE; it always gets there, MOST_ROUNDS only ends a fit that would not.
CLOSE, MOST_ROUNDS, THRESHOLD = 1e-6, 10_000, 0.5
SYMBOLS = "[#*$%&|<>]"
#: Ends of words with two or more marks, and words of one mark, in a text whose words stand between single spaces.
ODD = r"[^\p{L}\p{N}][^\p{L}\p{N}\x20](?=\x20)"

#: (name, measure, good if the measure is within, bad if it is outside of); between the two a rule abstains.
RULES = (
    ("length", "n_words", (100, 100_000), (LEAST_WORDS, 200_000)),
    ("word_length", "word_chars / n_words", (3, 10), (2, 14)),
    ("symbols", "n_symbols / n_words", (0, 0.03), (0, 0.1)),
    ("repeated_lines", "n_dup_lines / n_lines", (0, 0.15), (0, 0.4)),
    ("repeated_words", "n_repeat_words / n_words", (0, 0.15), (0, 0.4)),
    ("capitals", "n_capitals / word_chars", (0, 0.15), (0, 0.4)),
    ("exclamations", "n_exclamations / n_words", (0, 0.05), (0, 0.25)),
    ("ended_lines", "n_ended_lines / n_lines", (0.5, 1), (0.1, 1)),
    ("plain_words", "n_odd_words / n_words", (0, 0.05), (0, 0.2)),
)

#: Words in 3-word windows that the text has at least twice: hashes of the windows are
#: sorted with their places; places with an equal neighbour cover up to 3 words each.
_REPEATED = """
CASE WHEN size(words) < 4 THEN 0L ELSE
transform(array(transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))), g ->
  CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE
  transform(array(array_sort(transform(g, (h, i) -> struct(h AS h, i AS i)))), s ->
    transform(array(array_sort(transform(
        filter(s, (x, k) -> (k > 0 AND get(s, k - 1).h = x.h) OR (k + 1 < size(s) AND get(s, k + 1).h = x.h)), x -> x.i))), p ->
      aggregate(sequence(0, size(p) - 1), 0L, (n, k) -> n + least(3, coalesce(get(p, k + 1), get(p, k) + 3) - get(p, k))))[0])[0]
  END)[0]
END
"""


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measures of each whole text; null counts as empty and has no words and lines.

    Words come from one pass that squeezes white space; the patterns that are counted are
    single characters, but for odd words.
    """
    text, line = F.col("_text"), F.col("_line")
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("_text"))
    nothing = F.array().cast("array<string>")
    rows = rows.select("doc_id", "_text", F.trim(squeezed(text)).alias("_line"))
    rows = rows.select(
        "doc_id",
        "_text",
        "_line",
        F.when(line == "", nothing).otherwise(F.split(line, " ")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    last = lambda x: F.right(F.rtrim(x), F.lit(1))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(line == "", 0).otherwise(F.length(line) - F.size("words") + 1).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.regexp_count(F.concat(F.lit(" "), line, F.lit(" ")), F.lit(ODD)).cast("long").alias("n_odd_words"),
        F.size(F.filter("lines", lambda x: last(x).isin(*'.!?:;")'))).cast("long").alias("n_ended_lines"),
    )


def vote(measure: str, good: tuple[float, float], bad: tuple[float, float]) -> Column:
    """1 within ``good``, 0 outside of ``bad``, else null; null also where there is nothing to measure."""
    x = F.expr(f"try_divide({measure.replace(' / ', ', ')})") if " / " in measure else F.col(measure)
    return F.when(x.between(*good), 1).when((x < bad[0]) | (x > bad[1]), 0)


def log_odds(rules: list[str], model: dict) -> Column:
    """Log odds of a good document under the model, from the votes."""
    total = F.lit(math.log(model["good"] / (1 - model["good"])))
    for rule in rules:
        a, b = model[rule]  # P(votes good | good), P(votes bad | bad)
        total = total + F.when(F.col(rule) == 1, math.log(a / (1 - b))).when(F.col(rule) == 0, math.log((1 - a) / b)).otherwise(0.0)
    return total


def fit(votes: DataFrame, rules: list[str]) -> dict:
    """Expectation-maximisation over the vote patterns, counted once by Spark.

    They are at most 3 to the number of rules, whatever the corpus size, and the driver
    works on them alone. Rules are taken to be better than chance, which settles which
    class is the good one. ``moved`` is the last round's largest change.
    """
    patterns = [tuple(r) for r in votes.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).collect()]
    model: dict = {"good": 0.8} | {rule: (0.98, 0.4) for rule in rules} | {"moved": 0.0}
    total = sum(p[-1] for p in patterns)
    for _ in range(MOST_ROUNDS if total else 0):
        good, sums = 0.0, {rule: [0.0, 0.0, 0.0, 0.0] for rule in rules}  # good and bad documents by vote 0 and 1
        logs = [(math.log((1 - model[r][0]) / model[r][1]), math.log(model[r][0] / (1 - model[r][1]))) for r in rules]
        start = math.log(model["good"] / (1 - model["good"]))
        for *own, n in patterns:
            odds = start + sum(log[v] for log, v in zip(logs, own) if v is not None)
            p = n / (1 + math.exp(-odds))
            good += p
            for rule, v in zip(rules, own):
                if v is not None:
                    sums[rule][v] += p
                    sums[rule][2 + v] += n - p
        share = lambda yes, no, least: min(max((yes + 1) / (yes + no + 2), least), 0.999)
        new: dict = {"good": min(max(good / total, 0.02), 0.98)}
        for rule, (good0, good1, bad0, bad1) in sums.items():
            a = share(good1, good0, 0.6)
            new[rule] = a, share(bad0, bad1, min(0.5, 2 * (1 - a)))
        flat = lambda m: [m["good"], *(x for rule in rules for x in m[rule])]
        new["moved"] = max(abs(x - y) for x, y in zip(flat(new), flat(model)))
        model = new
        if model["moved"] < CLOSE:
            break
    return model


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Measures, votes, posterior and verdict of each row of ``docs``.

    ``kept`` is false where ``base_failed``, else the posterior decides. Null and empty
    texts have fewer than 50 words and so fail; texts of any length are measured whole;
    repeated rows are judged alike; an empty table gives an empty result; other columns
    are not looked at.
    """
    rules = [name for name, *_ in RULES]
    measured = measures(docs, id_column, text_column)
    voted = checkpointed(measured.select("*", *[vote(*rule).alias(name) for name, *rule in RULES]))
    posterior = 1 / (1 + F.exp(-log_odds(rules, fit(voted, rules))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (posterior >= threshold)).alias("kept"), posterior.alias("posterior"),
    )

"""Quality rules with risk-controlled cutoffs.

Signals are counted per document. A rule rejects a document whose signal exceeds the
rule's cutoff in the document's stratum (its language). The candidate cutoffs of each rule
are fixed beforehand, from lenient to strict. On the labelled holdout, the number of good
documents that a cutoff would reject gives an exact binomial p-value for the hypothesis
"it falsely rejects more than the allowed share". In each (stratum, rule) the cutoffs are
tested in their fixed order until one isn't certified; the level is divided by the number
of (stratum, rule) pairs. So with probability 1 - DELTA no stratum loses more than ALPHA of
its good documents: ALPHA is shared out evenly over the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NOT_WS, materialise, single_spaced, small_side

#: Share of good documents that may be rejected in a stratum, and the chance of a miss.
ALPHA, DELTA = 0.02, 0.05
#: Rule: cutoffs from lenient to strict. A document with a signal above the cutoff goes.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.5, 0.3, 0.25, 0.2, 0.15, 0.1),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
    "repeat_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5),
    "mean_word": (20.0, 15.0, 12.0, 11.0, 10.0),
}
SYMBOLS = "[#*$%&|<>]"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def signals(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Repeated windows: the 3-word windows of a text are compared as strings. Only if two are
    equal are they sorted with their places; windows equal to a sorted neighbour cover
    their three words."""
    d = docs.select(F.struct(*keep).alias("keep"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("flat", F.trim(single_spaced(F.col("text"))))
    d = d.withColumn("words", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " ")))
    places = F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_WS))
    d = d.select(
        "keep",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.replace("flat", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.when(F.contains("text", F.lit("\n")), lines).otherwise(F.filter(F.array("text"), lambda x: x.rlike(NOT_WS))).alias("lines"),
        F.transform(places, window).alias("windows"),
    )
    d = d.select(
        "keep", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("runs"),
    )
    near = lambda x, i: F.get("runs", i - 1)["g"].eqNullSafe(x["g"]) | F.get("runs", i + 1)["g"].eqNullSafe(x["g"])
    d = d.withColumn("found", F.when(F.col("runs").isNotNull(), F.transform(F.filter("runs", near), lambda x: x["i"])))
    covered = F.size(F.array_distinct(F.concat("found", F.transform("found", lambda i: i + 1), F.transform("found", lambda i: i + 2))))
    repeats = F.when(F.col("found").isNotNull(), covered).otherwise(0).cast("long")
    # The partition's number is never negative. As it isn't deterministic, filters on the signals
    # stay above this point; below it they would compute the windows again for each of them.
    repeats = F.when(F.spark_partition_id() >= 0, repeats)
    return d.select("keep.*", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    return {
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
        "mean_word": _ratio(F.col("word_chars"), F.col("n_words")),
    }


def _log_gamma(x: Column) -> Column:
    """For x >= 1, by Stirling's series at x + 8; relative error below 1e-13."""
    y = x + 8.0
    shift = x
    for i in range(1, 8):
        shift = shift * (x + float(i))
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.ln(shift)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p); 1 where k is n * p or more, which certifies nothing.

    The terms are summed downwards from k by their ratios, so nothing is lost to underflow;
    terms further away than ten standard deviations are below the rounding error."""
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p))
    far = F.least(k, F.ceil(10 * F.sqrt(n)) + 50).cast("int")
    step = lambda acc, j: F.struct(
        (acc["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"),
        (acc["total"] + acc["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("total"),
    )
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    steps = F.when(far > 0, F.sequence(F.lit(0), far - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top + F.ln(F.aggregate(steps, start, step)["total"]))))


def certified_cutoffs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and a column for each rule: its strictest certified cutoff, null if none.

    holdout: stratum, good (boolean) and the signals of the labelled documents. The number
    of falsely rejected documents only grows along a rule's cutoffs, so those certified are
    the first ones of the fixed order and the last of them is the least."""
    rules = rule_values()
    tests = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (rules[r] > c).alias("rejects")) for r, cuts in RULES.items() for c in cuts]
    tested = (
        holdout.where("good").select("stratum", F.explode(F.array(*tests)).alias("t"))
        .groupBy("stratum", "t.rule", "t.cutoff").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t.rejects").cast("long")).alias("k"))
    )
    tested = materialise(tested, "quality-tests")
    pairs = max(1, tested.select("stratum", "rule").distinct().count())
    sure = binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= delta / pairs
    return tested.groupBy("stratum").agg(*[F.min(F.when((F.col("rule") == r) & sure, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def verdict(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """counted (stratum and signals) with base_failed and kept."""
    cut = small_side(cutoffs.withColumnRenamed("stratum", "cut_stratum"), 100_000)
    joined = counted.join(cut, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    rejected = F.lit(False)
    for r, v in rule_values().items():
        rejected = rejected | F.coalesce(v > F.col(f"cut_{r}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def _good(labels: DataFrame, id_col: str, quality_col: str) -> DataFrame:
    """A document that is labelled more than once is good if all its labels are."""
    return labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg((F.min(quality_col) == 1).alias("good"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", quality_col: str = "quality") -> DataFrame:
    """One row for each row of docs: id, stratum, the signals, base_failed, kept.

    A null text has no words and fails the base rules. A null stratum is a stratum of its
    own. Strata with too few labelled good documents get no certified cutoff, so there only
    the base rules reject. Documents that fail the base rules aren't part of the holdout.
    Null labels, labels of no document, and all other columns are ignored. Without labels,
    or with an empty table, only the base rules hold."""
    counted = materialise(signals(docs, F.col(text_col), [F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum")]), "quality-signals")
    holdout = counted.where(~base_failed()).join(_good(labels, id_col, quality_col), F.col("id") == F.col("label_id"))
    judged = verdict(counted, materialise(certified_cutoffs(holdout), "quality-cutoffs"))
    return judged.select(F.col("id").alias(id_col), "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", quality_col: str = "quality") -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns and no shuffle of texts
    while the labels are few enough to broadcast."""
    keys = [F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum")]
    good = materialise(_good(labels, id_col, quality_col), "quality-labels")
    labelled = docs.select(id_col, text_col, stratum_col).join(small_side(good, 500_000), F.col(id_col) == F.col("label_id"))
    holdout = signals(labelled, F.col(text_col), [*keys, "good"]).where(~base_failed())
    cutoffs = materialise(certified_cutoffs(holdout), "quality-cutoffs")
    counted = signals(docs, F.col(text_col), [keys[1], F.struct("*").alias("row")])
    return verdict(counted, cutoffs).where("kept").select("row.*")


def _oracle() -> str:
    cuts = ", ".join(f"('{r}', {c!r}::DOUBLE)" for r, cs in RULES.items() for c in cs)
    value = "CASE rule WHEN 'symbol_ratio' THEN n_symbols / greatest(word_chars, 1) WHEN 'dup_line_ratio' THEN n_dup_lines / greatest(n_lines, 1) WHEN 'repeat_ratio' THEN n_repeat_words / greatest(n_words, 1) ELSE word_chars / greatest(n_words, 1) END"
    a = ALPHA / len(RULES)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rid, * EXCLUDE (doc_id) FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM g WHERE len(w) >= 3),
win2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM win),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM win2, (VALUES (0), (1), (2)) t(o) WHERE c > 1 GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM g),
s AS (SELECT doc_id, rid, lang, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM g JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT b.* FROM b JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE q = 1 AND NOT base_failed),
cuts(rule, cutoff) AS (VALUES {cuts}),
t AS (SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (({value}) > cutoff) AS k FROM h, cuts GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {a} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln(1 - {a})))) END AS pv,
    (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM t)) AS pairs FROM t),
c AS (SELECT lang, rule, min(cutoff) AS cutoff FROM p WHERE pv <= {DELTA} / pairs GROUP BY ALL),
bad AS (SELECT DISTINCT rid FROM b JOIN c ON b.lang IS NOT DISTINCT FROM c.lang WHERE ({value}) > cutoff)
SELECT doc_id, lang AS stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept
FROM b LEFT JOIN bad USING (rid)
"""


ORACLE = _oracle()

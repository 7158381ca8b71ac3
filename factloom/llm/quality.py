"""Quality rules whose cutoffs come from labelled holdouts under a guaranteed bound on false rejection.

Everything is DataFrame functions: each text's measures are array functions within its own row, so no text is
exploded or shuffled, and the cutoffs come from a histogram of the labelled rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, let, once

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
#: A document is rejected by a measure above its stratum's cutoff.  Cutoffs are tried from the mildest on.
CUTOFFS = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "dup_line_share": [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeat_share": [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "long_words": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0],
    "short_words": [-1.0, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0],
}
#: At most RISK of a stratum's good documents are rejected, in all strata at once with probability 1 - DELTA.
RISK, DELTA = 0.01, 0.05
#: Cutoffs of so many strata, and so many ids of labelled documents, are broadcast; more are joined by a shuffle.
BROADCAST_STRATA, BROADCAST_LABELS = 10_000, 500_000


def _repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words found twice or more in the text.

    Hashes find the candidates; equal windows are told by their words.
    """
    size = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))

    def twice(rows: Column, key: str) -> Column:
        """The rows (sorted structs) whose key a neighbour has too."""
        same = lambda a, b: F.coalesce(F.get(rows, a)[key] == F.get(rows, b)[key], F.lit(False))
        return F.filter(rows, lambda _, k: same(k, k - 1) | same(k, k + 1))

    def exact(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        found = let(by_hash, lambda rows: twice(rows, "h"))
        by_words = F.sort_array(
            F.transform(found, lambda r: F.struct(F.array_join(F.slice(words, r["at"] + 1, F.lit(WINDOW)), " ").alias("g"), r["at"].alias("at")))
        )
        places = F.sort_array(F.transform(let(by_words, lambda rows: twice(rows, "g")), lambda r: r["at"]))
        covered = let(places, lambda p: F.transform(p, lambda at, k: F.least(F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    return F.when(size < WINDOW, none).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(exact(h)))
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the measures.

    A null text has no words; shares of nothing are zero.  Columns of ``docs`` with the names of the results are
    replaced, all others stay.  Repeated rows are measured alike; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = once(docs, {"__quality_text": text, "__quality_words": F.array_remove(F.split(text, f"{SPACE}+"), "")})
    lines = F.filter(F.split("__quality_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = once(
        split,
        {
            "n_words": F.size("__quality_words").cast("long"),
            "word_chars": F.length(F.translate("__quality_text", " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length("__quality_text") - F.length(F.translate("__quality_text", "#*$%&|<>", ""))).cast("long"),
            "__quality_lines": let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("different"))),
            "n_repeat_words": _repeated_words(F.col("__quality_words")),
        },
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    mean = share(F.col("word_chars"), F.col("n_words"))
    return counted.withColumns(
        {
            "n_dup_lines": (F.col("__quality_lines.all") - F.col("__quality_lines.different")).cast("long"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
            "dup_line_share": share((F.col("__quality_lines.all") - F.col("__quality_lines.different")), F.col("__quality_lines.all")),
            "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
            "long_words": mean,
            "short_words": -mean,
        }
    ).drop("__quality_text", "__quality_words", "__quality_lines")


def _ln_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x >= 1 by Stirling's series eight places further on."""
    y = x + 8.0
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    for i in range(8):
        series = series - F.ln(x + float(i))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), for k <= n * p; 1 above that, where no cutoff can pass.

    The largest term comes from ln(gamma), the others by their ratios.  Terms more than 40 standard
    deviations and 400 places below the largest are under 1e-300 of it and left out.
    """
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(_ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p) + 400)).cast("int")
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    walk = F.when(steps < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), steps))
    total = F.aggregate(walk, state, add)["total"]
    return F.when(k > n * p, F.lit(1.0)).otherwise(top * total)


def select_cutoffs(labelled: DataFrame, stratum: str = "stratum", good: str = "good", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum: for each measure the sharpest cutoff that holds the risk, or null.

    ``labelled``: measured rows of the holdout, with a boolean ``good``.  Of n good rows, k lie above a cutoff;
    it passes if P(Bin(n, risk / measures) <= k) <= delta / (strata * measures).  The risk is divided among the
    measures, since a row is rejected by any of them.  A measure's cutoffs are tested from the mildest on
    until one fails, which needs no further correction; strata and measures share delta (Bonferroni).
    """
    names = list(CUTOFFS)
    part = risk / len(names)
    rows = labelled.where(F.col(good)).select(
        stratum,
        F.explode(
            F.array(
                *[
                    # How many of the measure's cutoffs the row lies above.  They fall, so these are the last ones.
                    F.struct(F.lit(m).alias("measure"), sum((F.col(m) > c).cast("int") for c in CUTOFFS[m]).alias("above"))
                    for m in names
                ]
            )
        ).alias("x"),
    )
    # A row per stratum, measure and number of cutoffs; kept, so that the rows are measured once.
    counts = checkpoint(rows.groupBy(stratum, "x.measure", "x.above").agg(F.count("*").alias("n")))
    grid = F.create_map(*[y for m in names for y in (F.lit(m), F.array(*[F.lit(c) for c in CUTOFFS[m]]))])
    tried = counts.groupBy(stratum, "measure").agg(F.sum("n").alias("n"), F.collect_list(F.struct("above", "n")).alias("h"))
    # At most one entry for each number of cutoffs, so the list stays short.
    tried = tried.select(
        stratum, "measure", "n", F.posexplode(F.element_at(grid, F.col("measure"))).alias("step", "cutoff"), "h", F.size(F.element_at(grid, F.col("measure"))).alias("steps")
    ).withColumn(
        "k",
        F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.when(x["above"] >= F.col("steps") - F.col("step"), x["n"]).otherwise(0)),
    )
    strata = counts.agg(F.countDistinct(stratum)).first()[0]
    order = Window.partitionBy(stratum, "measure").orderBy("step")
    level = delta / (max(strata, 1) * len(names))
    tested = tried.withColumn("passes", F.min((binomial_tail(F.col("k"), F.col("n"), part) <= level).cast("int")).over(order))
    return tested.groupBy(stratum).agg(*[F.min(F.when((F.col("measure") == m) & (F.col("passes") == 1), F.col("cutoff"))).alias(f"cut_{m}") for m in names])


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``select_cutoffs`` for the rows of ``measured`` that ``labels`` knows.

    Of a label's repeated rows the smallest value counts; null labels and ids don't.
    """
    rows = labelled_good(measured.select(F.col(id_col), _stratum(stratum_col), *CUTOFFS), labels, id_col, label_id, label)
    return checkpoint(select_cutoffs(rows.withColumn("good", F.lit(True))))


def labelled_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """Rows of ``docs`` that ``labels`` calls good, the only ones that cutoffs are chosen by.

    Their ids are broadcast up to BROADCAST_LABELS of them, so that texts aren't shuffled for a small holdout.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.min(label).alias("_least")).where("_least = 1").select("_id")
    small = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.join(F.broadcast(known) if small else known, F.col(id_col) == F.col("_id"), "left_semi")


def _stratum(stratum_col: str) -> Column:
    return F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum")


def verdicts(measured: DataFrame, cuts: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``measured`` with ``kept``: not base_failed, and below every cutoff of its stratum."""
    cuts = cuts.withColumnRenamed("stratum", "_stratum")
    small = cuts.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    rejected = F.lit(False)
    for m in CUTOFFS:
        rejected = rejected | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    rows = measured.withColumn("_own", _stratum(stratum_col))
    joined = rows.join(F.broadcast(cuts) if small else cuts, F.col("_own") == F.col("_stratum"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_own", "_stratum", *[f"cut_{m}" for m in CUTOFFS])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The measures of ``docs`` and ``kept``, without the text.

    Strata are the values of ``stratum_col``, null being one of them; a stratum without labelled rows, or
    with too few for any cutoff to pass, rejects nothing.  Repeated documents stay.  Empty tables give an
    empty result or no cutoffs.
    """
    measured = checkpoint(measure(docs.select(id_col, text_col, stratum_col), text_col).drop(text_col))
    return verdicts(measured, cutoffs(measured, labels, id_col, stratum_col), stratum_col)

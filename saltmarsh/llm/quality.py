"""Quality rules: word rules, and robust multivariate outliers per language and source.

Every document gets a vector of transformed statistics. Per language and source a minimum-
covariance-determinant estimate of centre and scatter is fitted to all its documents by
concentration steps from several starts, until they settle; the least determinant counts. Documents
far away by Mahalanobis distance are rejected. The estimates are regularised: centre and scatter are
weighed against the medians and deviations of the language, which count as PRIOR documents more, so
that groups of any size, one document too, have an estimate by the same rule. Only DataFrame
functions run on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import WORD, discard, staged, table, text_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Share of a group's documents that the estimate is concentrated on; documents that the language
#: counts as in a group's estimate; concentration steps at most, and the change of the log determinant
#: from which on they go on.
CORE, PRIOR, STEPS, SETTLED = 0.75, 10.0, 12, 1e-3
#: Group tables of up to so many rows (of some 20 numbers) are sent to all tasks; larger ones are joined
#: by a shuffle.
SENT_GROUPS = 50_000
#: Chi-square quantiles for 4 degrees of freedom. P(chi2(6) <= the 0.75
#: quantile of chi2(4)), for the consistency factor of CORE; the 1 - 1e-7 quantile of chi2(4).
CHI2_6_AT_CORE, CUTOFF = 0.504570, 38.239600
#: Least standard deviation of each statistic: smaller spreads are not told from none.
LEAST_SD = (0.03, 0.06, 0.03, 0.03)
DIMS = range(4)


def text_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines. Null text: all zero.

    Repeats are found by comparing 64-bit hashes of 8-word windows within one text.
    """
    text = text_of()
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = docs.withColumn("_words", words)
    n = F.size("_words")

    def shifted_pairs(values: Column, by: int) -> Column:
        """Hashes of values[i], values[i + by]: doubles the window that a hash stands for."""
        count = F.size(values) - by
        return F.zip_with(F.slice(values, 1, F.greatest(count, F.lit(0))), F.slice(values, by + 1, F.greatest(count, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    rows = rows.withColumn("_h", F.when(n < WINDOW, F.array().cast("array<long>")).otherwise(F.transform("_words", lambda w: F.xxhash64(w))))
    for by in (1, 2, 4):
        rows = rows.withColumn("_h", F.when(F.size("_h") > by, shifted_pairs(F.col("_h"), by)).otherwise(F.array().cast("array<long>")))
    # The starts of windows that occur twice or more, by sorting (hash, place) and looking at both neighbours.
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    edge = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    marked = lambda s: F.filter(F.zip_with(F.zip_with(s, F.concat(edge, s), lambda a, b: F.struct(a.alias("x"), (a["h"] == b["h"]).alias("same"))), F.concat(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), edge), lambda p, c: F.when(F.coalesce(p["same"], F.lit(False)) | F.coalesce(p["x"]["h"] == c["h"], F.lit(False)), p["x"]["i"])), lambda v: v.isNotNull())
    starts = F.sort_array(marked(pairs))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")), lambda a, i: F.struct((a["n"] + F.lit(WINDOW) - F.greatest(a["end"] - i, F.lit(0))).cast("int").alias("n"), (i + WINDOW).cast("int").alias("end")))["n"]
    repeat = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), covered).otherwise(F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    rows = rows.withColumn("_lines", lines)
    return rows.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def statistic_vector() -> list[Column]:
    """Log mean word length, symbols a word, repeated lines, repeated words; each shrunk towards the
    usual value by some 50 words (5 lines), so that short documents don't scatter more than long ones."""
    n = F.col("n_words") + 50.0
    return [
        F.ln((F.col("word_chars") + 300.0) / n),
        F.log1p(10.0 * F.col("n_symbols") / n),
        F.col("n_dup_lines") / (F.col("n_lines") + 5.0),
        F.col("n_repeat_words") / n,
    ]


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with a written table of a row per group: sent to the rows if it is small, so that a
    large group stays spread over its tasks."""
    return rows.join(F.broadcast(groups) if groups.count() <= SENT_GROUPS else groups, keys)


def _factor(found: DataFrame, keys: list[str]) -> DataFrame:
    """Centre (m) and scatter (s) -> centre, Cholesky factor (l) of the scatter and its log determinant."""
    out = found
    for i in DIMS:
        for j in range(i + 1):
            rest = F.col(f"s{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(LEAST_SD[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = sum((2 * F.ln(f"l{i}{i}") for i in DIMS[1:]), 2 * F.ln("l00"))
    return out.select(*keys, *[f"m{i}" for i in DIMS], *[f"l{i}{j}" for i in DIMS for j in range(i + 1)], log_det.alias("log_det"))


def _estimates(rows: DataFrame, prior: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """The regularised centre and scatter of the rows of each group. prior: a row per group."""
    x = [f"x{i}" for i in DIMS]
    sums = [F.avg(c).alias(f"a{i}") for i, c in enumerate(x)] + [F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i in DIMS for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*sums).join(prior, "grp")
    own = F.col("n") / (F.col("n") + PRIOR)
    centre = [(own * F.col(f"a{i}") + (1 - own) * F.col(f"p{i}")).alias(f"m{i}") for i in DIMS]
    spread = [(own * scale * F.col(f"c{i}{j}") + ((1 - own) * F.col(f"t{i}") + LEAST_SD[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i in DIMS for j in range(i + 1)]
    return _factor(out.select(*keys, *centre, *spread), keys)


def _distance() -> Column:
    """The squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i in DIMS:
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _medians(rows: DataFrame, key: str) -> DataFrame:
    """Coordinatewise medians p and squared deviations t (1.4826 times the median deviation) by key."""
    mid = staged(rows.groupBy(key).agg(*[F.percentile_approx(f"x{i}", 0.5).alias(f"p{i}") for i in DIMS]), "medians")
    spread = _with_groups(rows, mid, [key]).groupBy(key).agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"p{i}")), 0.5).alias(f"d{i}") for i in DIMS])
    return mid.join(spread, key).select(key, *[f"p{i}" for i in DIMS], *[F.pow(1.4826 * F.col(f"d{i}"), 2).alias(f"t{i}") for i in DIMS])


def mcd_estimates(rows: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """rows: grp, lang, x0..x3 (all documents; a grp is of one lang) -> centre and scatter per group.

    Four starts: the group's medians and deviations, those of its language, the moments of all its
    documents and those of a third. Each step keeps the `core` nearest documents of every group and
    start and estimates again from them; of the starts the one with the least determinant counts.
    """
    keys, scale = ["grp", "start"], core / CHI2_6_AT_CORE
    langs = _medians(rows, "lang")
    sizes = rows.groupBy("grp").agg(F.max("lang").alias("lang"), F.count("*").alias("n"))
    prior = staged(sizes.join(langs, "lang").drop("lang").repartition(1), "mcd_prior")
    own = _medians(rows, "grp").join(prior.select("grp"), "grp")
    starts = [
        _factor(t.select("grp", F.lit(k).alias("start"), *[F.col(f"p{i}").alias(f"m{i}") for i in DIMS], *[(F.col(f"t{i}") + LEAST_SD[i] ** 2 if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i in DIMS for j in range(i + 1)]), keys)
        for k, t in enumerate((own, prior))
    ]
    third = F.pmod(F.xxhash64(*[f"x{i}" for i in DIMS]), F.lit(3)) == 0
    starts += [_estimates(r.withColumn("start", F.lit(k)), prior, keys, scale) for k, r in ((2, rows), (3, rows.filter(third)))]
    found = starts[0]
    for more in starts[1:]:
        found = found.unionByName(more)
    found = staged(found.repartition(1), "mcd")
    for _ in range(steps):
        far = _with_groups(rows, found, ["grp"]).withColumn("d2", _distance()).select("grp", "start", "d2", *[f"x{i}" for i in DIMS])
        limits = staged(far.groupBy(*keys).agg(F.percentile_approx("d2", core, 2000).alias("limit")).repartition(1), "mcd_limits")
        inside = _with_groups(far, limits, keys).filter("d2 <= limit")
        now = staged(_estimates(inside, prior, keys, scale).repartition(1), "mcd")
        change = now.join(found.select(*keys, F.col("log_det").alias("_was")), keys).agg(F.max(F.abs(F.col("log_det") - F.col("_was")))).first()[0]
        discard(limits, found)
        found = now
        if change is None or change < SETTLED:
            break
    least = found.groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("_least"))
    best = found.join(least, "grp").filter("start = _least.start").drop("_least", "start", "log_det")
    return staged(best.repartition(1), "mcd_best")


def _judged(docs: DataFrame, carried: Column, cutoff: float) -> DataFrame:
    """_doc (what is carried), the statistics and the verdict; one row per row."""
    base = text_statistics(docs.select(carried.alias("_doc"), "text", "lang", "source")).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source"))
    base = base.withColumn("base_failed", failed).withColumn("grp", F.concat_ws("\n", lang, source)).withColumn("lang", lang).drop("source")
    stats = staged(base.select("*", *[x.alias(f"x{i}") for i, x in enumerate(statistic_vector())]), "quality_stats")
    found = mcd_estimates(stats.filter("not base_failed").select("grp", "lang", *[f"x{i}" for i in DIMS]))
    # Groups without an estimate have failed documents only.
    judged = stats.join(F.broadcast(found) if found.count() <= SENT_GROUPS else found, "grp", "left").withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & (F.col("distance2") <= cutoff)
    return judged.withColumn("kept", F.coalesce(kept, F.lit(False)))


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs: doc_id, text, lang, source -> one row per row with the statistics and the verdict.

    base_failed: under 20 words, or over 30% of the words in repeated 8-word windows. kept: not
    base_failed and within the cutoff of its group's estimate. Estimates are fitted to all documents
    that pass the base rules. Null language or source is a value of its own. Null and empty texts
    fail the base rules; texts may be of any length; ties and repeated rows get the same verdict; an
    empty table gives an empty one. Other columns, of whatever names, are ignored.
    """
    judged = _judged(docs, F.col("doc_id"), cutoff)
    return judged.select(F.col("_doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The kept rows of docs, all columns as they are. Each row is judged by its own text, also if
    others share its doc_id. Otherwise as judge."""
    return _judged(docs, F.struct(*docs.columns), cutoff).filter("kept").select("_doc.*")


def op8_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))



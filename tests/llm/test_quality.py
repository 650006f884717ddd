import re
from collections import Counter

import numpy as np
from fixtures import SF, documents, empty_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from saltmarsh.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_statistics_equal_brute_force(spark):
    for docs, texts in ((odd_docs(spark), {r[0]: r[1] for r in odd_rows()}), (documents(spark), {r.doc_id: r.text for r in documents(spark).collect()})):
        got = quality.judge(docs).collect()
        assert len(got) == docs.count()
        for r in got:
            if r.doc_id is not None:
                assert tuple(r)[1:7] == slow_statistics(texts[r.doc_id]), r.doc_id
    assert quality.judge(empty_docs(spark)).count() == 0


def slow_estimates(rows):
    """rows: (key, grp, lang, base_failed, x) -> {grp: (centre, scatter)} from many starts, by numpy."""
    fit = [r for r in rows if not r[3]]
    least = np.square(quality.LEAST_SD)
    scale = quality.CORE / quality.CHI2_6_AT_CORE
    estimates = {}
    for grp in {r[1] for r in fit}:
        lang = next(r[2] for r in fit if r[1] == grp)
        all_lang, x = (np.array([r[4] for r in fit if r[k] == v]) for k, v in ((2, lang), (1, grp)))
        mid = np.percentile(all_lang, 50, axis=0, method="inverted_cdf")
        dev = (1.4826 * np.percentile(abs(all_lang - mid), 50, axis=0, method="inverted_cdf")) ** 2
        n, h = len(x), int(np.ceil(quality.CORE * len(x)))
        own = n / (n + quality.PRIOR)

        def estimate(part):
            centre = part.mean(0)
            spread = (part - centre).T @ (part - centre) / len(part)
            return own * centre + (1 - own) * mid, own * scale * spread + np.diag((1 - own) * dev + least)

        best, rng = None, np.random.default_rng(0)
        for start in range(30):
            m, s = estimate(x if start == 0 else x[rng.integers(0, n, max(1, n // 3))])
            for _ in range(30):
                d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
                m, s = estimate(x[np.argsort(d, kind="stable")[:h]])
            if best is None or np.linalg.slogdet(s)[1] < best[0]:
                best = np.linalg.slogdet(s)[1], m, s
        estimates[grp] = best[1:]
    return estimates


def slow_verdicts(rows):
    estimates, out = slow_estimates(rows), {}
    for key, grp, _, failed, x in rows:
        if failed:
            out[key] = False
        else:
            m, s = estimates[grp]
            out[key] = (x - m) @ np.linalg.inv(s) @ (x - m) <= quality.CUTOFF
    return out


def test_mcd_is_the_centre_of_the_clean_rows(spark):
    rng = np.random.default_rng(3)
    clean = rng.multivariate_normal([1.6, 0.1, 0.2, 0.1], np.diag([0.01, 0.02, 0.03, 0.01]) + 0.004, 900)
    far = rng.normal(6.0, 0.2, (100, 4))
    x = np.vstack([clean, far])
    df = spark.createDataFrame([("g", "l", *map(float, r)) for r in x], "grp string, lang string, x0 double, x1 double, x2 double, x3 double")
    got = quality.mcd_estimates(df).first()
    assert np.allclose([got[f"m{i}"] for i in range(4)], clean.mean(0), atol=0.03)
    lower = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            lower[i, j] = got[f"l{i}{j}"]
    centre, scatter = slow_estimates([(i, "g", "l", False, r) for i, r in enumerate(x)])["g"]
    # Not the same of the many minima that are nearly as low, but one as low and close by.
    assert np.allclose([got[f"m{i}"] for i in range(4)], centre, atol=5e-3)
    assert np.allclose(lower @ lower.T, scatter, rtol=0.05, atol=5e-4)
    assert np.linalg.slogdet(lower @ lower.T)[1] <= np.linalg.slogdet(scatter)[1] + 0.01  # of the best of thirty starts


def test_verdicts_equal_brute_force_per_language_and_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    vectors = quality.text_statistics(docs).select("doc_id", "lang", "source", *[c.alias(f"x{i}") for i, c in enumerate(quality.statistic_vector())]).collect()
    rows = [(r.doc_id, (r.lang, r.source), r.lang, got[r.doc_id].base_failed, np.array([r.x0, r.x1, r.x2, r.x3])) for r in vectors]
    want = slow_verdicts(rows)
    wrong = [i for i in want if want[i] != got[i].kept]
    assert len(wrong) <= 2 and sum(not r.kept and not r.base_failed for r in got.values()) > 20
    assert all(r.distance2 is not None for r in got.values() if not r.base_failed)


def test_outliers_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.judge(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((~F.col("kept") & ~F.col("base_failed")).cast("int")).alias("far")).collect()
    share = {r.quality: r for r in got}
    print(share)
    assert share[1].far < 0.01 and share[0].kept < 0.2


def test_stage_keeps_columns_and_rows(spark):
    docs = odd_docs(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and quality.keep_good(empty_docs(spark)).count() == 0
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in quality.judge(docs).collect() if r.kept)
    good = " ".join(f"word{i}" for i in range(40))
    twins = spark.createDataFrame([(1, good, "en", "a"), (1, "bad " * 40, "en", "a"), (None, good, "en", "a"), (None, "", "en", "a")], "doc_id long, text string, lang string, source string")
    assert sorted(str(r.doc_id) + r.text[:4] for r in quality.keep_good(twins).collect()) == ["1word", "Noneword"]
    assert quality.op8_mcd_quality(spark, SF).count() == documents(spark).count()

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sentrylake.llm import quality_classifier as qc
from sentrylake.llm import quality_rules as qr
from sentrylake.llm._shared import in_fold
from sentrylake.llm.queries import op1_quality_rules, op2_quality_classifier

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_base_counts_are_exact():
    for t in ("", "a b c a b c", "x\nx\n\nx \n", "## a|b <c>", "é ü \x1c z", *(r[1] for r in cases.rows() if r[1])):
        assert qr.measured(t)[:5] == counts(t)


def test_rules_on_awkward_rows(spark):
    got = qr.quality_rules(cases.frame(spark)).collect()
    assert len(got) == len(cases.rows())
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert sum(r.kept for r in got) > 25
    kept = qr.keep_passing(cases.frame(spark))
    cases.same_extras(cases.frame(spark), kept, every=False)
    assert kept.count() == sum(r.kept for r in got)
    assert qr.quality_rules(cases.empty(spark)).count() == 0


def test_estimates_follow_the_majority_and_reject_outliers(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(0, 0.3, (3000, qr.P))
    bad = rng.normal(4, 0.1, (600, qr.P))
    rows = [("en", "hot", x.tolist()) for x in np.concatenate([good, bad])]
    stats = spark.createDataFrame(rows, "lang string, source string, x array<double>")
    model = qr.fit(stats)
    m = model.where("g like '2%'").first()
    assert np.abs(np.array(m.center)).max() < 0.05
    sd = np.sqrt(np.diag(np.linalg.inv(np.array(m.precision).reshape(qr.P, qr.P))))
    assert np.abs(sd / 0.3 - 1).max() < 0.1  # the floors widen nothing that is wider
    d = np.array([r.d for r in qr.with_distance(stats, model, "x", "d").collect()])
    cut = qr.chi_square_quantile(qr.REJECT, qr.P)
    assert (d[:3000] > cut).sum() <= 1 and (d[3000:] > cut).all()


def test_chi_square():
    assert abs(qr.chi_square_quantile(0.95, 6) - 12.5916) < 1e-3 and abs(qr.chi_square_cdf(10, 3) - 0.981434) < 1e-5


def test_rules_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = qr.quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) == 0


def exact_estimate(x, rng):
    """The minimum-covariance-determinant estimate by sorting: the best of many starts, run to the end, reweighted."""
    n, best = len(x), None
    h = int(np.ceil(qr.COVERED * n))
    chi = lambda q, k=qr.P: qr.chi_square_quantile(q, k)
    for start in range(40):
        pick = rng.choice(n, min(16, n), replace=False) if start else np.argsort(np.abs((x - np.median(x, 0)) / (1.4826 * np.median(np.abs(x - np.median(x, 0)), 0) + np.array(qr.FLOORS))).max(1))[: max(n // 2, 1)]
        mean, cov = x[pick].mean(0), qr.raised(np.cov(x[pick].T, bias=True))
        last = np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = np.argsort(d)[:h]
            mean = x[near].mean(0)
            cov = qr.raised(qr.COVERED / qr.chi_square_cdf(chi(qr.COVERED), qr.P + 2) * np.cov(x[near].T, bias=True))
            det = np.linalg.slogdet(cov)[1]
            if det > last - 1e-9:
                break
            last = det
        if best is None or det < best[0]:
            best = det, mean, cov
    _, mean, cov = best
    inside = x[np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) <= chi(qr.REWEIGHT)]
    return inside.mean(0), qr.raised(qr.REWEIGHT / qr.chi_square_cdf(chi(qr.REWEIGHT), qr.P + 2) * np.cov(inside.T, bias=True))


def judged_apart(rows, got):
    """Base counts, and the verdicts of exact estimates of every language and source, drawn towards their language's and
    that towards all's; the documents within a fifth of the cut are counted, not compared."""
    groups, vector = {}, {}
    for i, text, lang, source in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if r.base_failed:
            assert not r.kept and r.distance is None
            continue
        vector[i] = qr.measured(text)[5]
        for g in ((), (lang,), (lang, source)):
            groups.setdefault(g, []).append(i)
    rng, model, near, apart = np.random.default_rng(3), {}, 0, 0
    for g, ids in sorted(groups.items(), key=lambda x: len(x[0])):
        mean, cov = exact_estimate(np.array([vector[i] for i in ids]), rng)
        if g:
            wide_mean, wide_cov = model[g[:-1]]
            n, k, gap = len(ids), qr.PRIOR, mean - wide_mean
            mean, cov = (n * mean + k * wide_mean) / (n + k), (n * cov + k * wide_cov) / (n + k) + n * k / (n + k) ** 2 * np.outer(gap, gap)
        model[g] = mean, cov
    cut = qr.chi_square_quantile(qr.REJECT, qr.P)
    for i, _, lang, source in rows:
        if i in vector:
            mean, cov = model[lang, source]
            x = np.array(vector[i]) - mean
            want = float(x @ np.linalg.inv(qr.raised(cov)) @ x)
            if abs(want / cut - 1) < 0.2:
                near += 1
            elif got[i].kept != (want <= cut):
                apart += 1
    return near, apart, len(vector), sum(not got[i].kept for i in vector)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = {r.doc_id: r for r in op1_quality_rules(spark, sf).collect()}
    assert len(got) == len(rows)
    near, apart, n, rejected = judged_apart(rows, got)
    assert near < 0.02 * n and apart == 0 and rejected > 0


def test_small_and_large_groups_against_brute_force(spark):
    """Groups of 3 to 900 documents of their own kinds, each with outliers of its own that others would keep."""
    rng, rows = np.random.default_rng(4), []
    for k, (lang, source, n) in enumerate((("en", "a", 900), ("en", "b", 300), ("en", "c", 30), ("en", None, 3), ("de", "a", 120), ("de", "b", 7), (None, None, 60))):
        for j in range(n):
            size = 3 + k % 4 + (9 if j % 50 == 7 else 0)
            words = ["".join(rng.choice(list("abcdefgh"), max(1, int(rng.normal(size, 1))))) for _ in range(80)]
            digits = rng.random(80) < 0.02 * k
            rows.append((len(rows), " ".join(w + "1" if d else w for w, d in zip(words, digits, strict=True)), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r for r in qr.quality_rules(docs).collect()}
    near, apart, n, rejected = judged_apart(rows, got)
    assert near < 0.03 * n and apart == 0 and rejected >= 20


def test_dual_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, 6, replace=False)).astype(np.int32) for _ in range(80)]
    y = np.where([x.min() < 4 for x in rows], 1, -1)
    r = np.zeros(1 << qc.BITS)
    r[:40] = rng.normal(0, 1, 40)
    w, b = qc.dual_coordinate_descent(rows, y, r, epochs=400)
    v = np.stack([np.bincount(x, r[x] / np.sqrt(r[x] @ r[x]), 40) for x in rows])
    hinge = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (v @ w + b)).sum()
    best = hinge(w[:40], b)
    for _ in range(200):
        assert hinge(w[:40] + rng.normal(0, 0.05, 40), b + rng.normal(0, 0.05)) >= best - 1e-3


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) >= 0.95


def test_scores_against_brute_force(spark, sf):
    """The query's scores from scratch: n-grams as strings, dense vectors, the definition of each step."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r.score for r in op2_quality_classifier(spark, sf).collect()}

    def places(text):
        out, b = set(), text.encode()
        for n in range(1, qc.ORDERS + 1):
            for gram in {b[i : i + n] for i in range(len(b) - n + 1)}:
                h = 0
                for k, c in enumerate(gram):
                    h = (h * 0x01000193 + (c + 1) * int(qc.SPREAD[k])) % 2**32
                out.add(((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32 >> (32 - qc.BITS))
        words = text.split()
        longest = run = 1
        for a, c in zip(words, words[1:], strict=False):
            run = run + 1 if a == c else 1
            longest = max(longest, run)
        return out | set(range(min(longest - 1, qc.RUNS))) if words else out

    train = [i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2 and i in docs]
    keys = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in train], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    train.sort(key=keys.get)
    assert len(train) <= qc.MAX_ROWS
    sets = {i: places(t) for i, t in docs.items()}
    column = {p: k for k, p in enumerate(sorted(set().union(*sets.values())))}
    x = {i: np.array([column[p] for p in s], int) for i, s in sets.items()}
    fit, judge = [i for k, i in enumerate(train) if k % 5 != 4], [i for k, i in enumerate(train) if k % 5 == 4]
    sign = {i: 1 if labels[i] > 0 else -1 for i in train}
    size = 1 << qc.BITS
    share = {}
    for s in (1, -1):
        n = np.zeros(len(column))
        for i in fit:
            if sign[i] == s:
                n[x[i]] += 1
        share[s] = (n + 1) / (n.sum() + size)
    r = np.log(share[1] / share[-1])
    dense = {}
    for i in docs:
        dense[i] = np.zeros(len(column))
        dense[i][x[i]] = r[x[i]]
        dense[i] /= max(np.linalg.norm(dense[i]), 1e-9)
    v = np.array([[*dense[i], 1.0] for i in fit])  # the intercept is a feature
    y, alpha, w = np.array([sign[i] for i in fit]), np.zeros(len(fit)), np.zeros(len(column) + 1)
    order = np.random.default_rng(7)
    for _ in range(12):
        for i in order.permutation(len(fit)):
            new = np.clip(alpha[i] - (y[i] * (w @ v[i]) - 1) / (v[i] @ v[i]), 0, 1)
            w += (new - alpha[i]) * y[i] * v[i]
            alpha[i] = new
    weight = 0.75 * np.abs(w[:-1]).sum() / size + 0.25 * w[:-1]
    margin = {i: dense[i] @ weight + 0.25 * w[-1] for i in docs}
    if len({sign[i] for i in judge}) < 2:  # the curve needs both classes
        judge = train
    a, b = qc.logistic(np.array([margin[i] for i in judge]), np.array([sign[i] for i in judge]))
    worst = max(abs(got[i] - 1 / (1 + np.exp(-(a * margin[i] + b)))) for i in docs)
    assert worst < 1e-3


def test_classifier_on_awkward_rows(spark):
    docs = cases.frame(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(49, 1), (49, 0), (None, 1), (47, None)], "doc_id long, quality int")
    for lab in (labels, labels.where("quality = 1"), labels.limit(0)):
        model = qc.fit(docs, lab, training=~in_fold(4, 2))
        got = docs.select("doc_id", "text", qc.score_column(docs, model).alias("s")).collect()
        assert len(got) == len(cases.rows()) and all(0 <= r.s <= 1 for r in got)
        assert len({r.s for r in got if not r.text}) == 1
    model = qc.fit(cases.empty(spark), labels)
    assert cases.empty(spark).select(qc.score_column(docs, model)).count() == 0


def test_labels_outside_the_training_fold_change_nothing(spark):
    docs = cases.frame(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(in_fold(4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (qc.fit(docs, x, training=~in_fold(4, 2)) for x in (labels, flipped))
    assert (a["wr"] == b["wr"]).all() and a["bias"] == b["bias"]

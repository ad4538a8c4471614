"""Quality rules: base counts, and robust multivariate outliers among the documents that pass them.

Each text gives a vector of transformed shares. Per source of a language, per language and over all the
minimum-covariance-determinant estimate is found by concentration steps: every document's
distance under the current estimate, then mean and covariance of the three quarters nearest to it. Distances are
gathered in narrow logarithmic bins with their moments, so a step is one grouping with partial sums over all
documents, and an estimate is made from at most BINS rows; the bin on the edge counts in part.

A group begins from several estimates: medians with median absolute deviations, and STARTS small subsets drawn by hash.
After two steps the one of the least determinant goes on, until no group's determinant falls any more. The estimate is
then corrected for consistency and reweighted once.

Every document is judged by the estimate of its own language and source. An estimate of n documents is drawn towards
that of the language as if PRIOR documents more had given the latter (its center, its scatter and the distance of the
centers), and the language's likewise towards that of all: few documents move what is known of the language a
little, many make it their own, without a switch between them. Documents beyond the chi-square quantile are rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import prepare, small_join, stored, text_bytes

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The vector: log of word length; square roots of symbols, upper-case letters, digits, marks and repeated words in proportion.
SHARES = ("length", "symbols", "upper", "digits", "marks", "repeats")
P = len(SHARES)
#: Least standard deviations: shares that are almost constant in a group would else reject any other value. Only variances
#: (along the axes of the scatter, in units of these) that are less are raised.
FLOORS = (0.06, 0.06, 0.06, 0.06, 0.12, 0.10)
COVERED, BINS, REWEIGHT, REJECT = 0.75, 640, 0.975, 0.9999999
#: Documents that the wider group's estimate counts for in the narrower one's.
PRIOR = 200
#: Drawn starts besides the medians, the documents of each, steps before the choice, and the least fall of log determinants.
STARTS, DRAWN, TRIED, SETTLED = 3, 16, 2, 1e-3
SPACE, SYMBOLS, DIGITS, MARKS = b" \t\n\v\f\r", b"#*$%&|<>", b"0123456789", b"!?;:"
UPPER = bytes(range(65, 91))
STRUCT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    v = len(number)
    key = ids[:-2] * v + ids[1:-1]
    if v > 2_000_000:  # the product of three would not fit in 64 bits
        key = np.unique(key, return_inverse=True)[1]
        v = len(ids)
    _, place, times = np.unique(key * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def measured(text: str) -> tuple:
    """The five base counts and the vector of one text."""
    b = text.encode()
    words = b.split()
    n = len(words)
    spaces = len(b) - len(b.translate(None, SPACE))
    chars = len(text) - spaces
    count = lambda which: len(b) - len(b.translate(None, which))
    symbols = count(SYMBOLS)
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeats = repeated_words(words)
    if not n:
        return 0, 0, symbols, dup, 0, [0.0] * P
    x = [math.log(chars / n), math.sqrt(symbols / n), math.sqrt(count(UPPER) / chars), math.sqrt(count(DIGITS) / chars), math.sqrt(count(MARKS) / n), math.sqrt(repeats / n)]
    return n, chars, symbols, dup, repeats, x


def stats_column(text: Column) -> Column:
    @F.pandas_udf(STRUCT)
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measured(t) for t in texts], columns=[*NAMES, "x"])

    return stats.asNondeterministic()(text)  # evaluated once, where it stands


def base_failed(stats: str = "") -> Column:
    n, r = F.col(f"{stats}n_words"), F.col(f"{stats}n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def group_keys(levels: tuple[str, ...] = ("lang", "source")) -> list[Column]:
    """A document's groups, narrowest first; a null name is a group of its own. The last one's key is made from a
    column, so that its join stays one by key."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in levels)
    return [F.concat(F.lit("2\x01"), lang, F.lit("\x01"), source), F.concat(F.lit("1\x01"), lang), F.concat(F.substring(lang, 1, 0), F.lit("0"))]


def chi_square_cdf(x: float, k: int) -> float:
    """The regularised lower incomplete gamma function at (k/2, x/2), by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    if z > a + 60:
        return 1.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-16 and n < 10_000:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi_square_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


def distance(x: Column, center: Column, precision: Column) -> Column:
    """The squared Mahalanobis distance."""
    d = [x[i] - center[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + (1.0 if i == j else 2.0) * precision[i * P + j] * d[i] * d[j]
    return total


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
ESTIMATE = "g string, start int, n long, logdet double, center array<double>, precision array<double>"


def raised(cov: np.ndarray) -> np.ndarray:
    """The scatter with its variances raised to the floors."""
    unit = np.outer(FLOORS, FLOORS)
    w, v = np.linalg.eigh(cov / unit)
    return (v * np.maximum(w, 1)) @ v.T * unit


def estimate(g: str, start: int, n: int, center: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    cov = raised(cov)
    return pd.DataFrame({"g": [g], "start": [start], "n": [n], "logdet": [np.linalg.slogdet(cov)[1]], "center": [center.tolist()], "precision": [np.linalg.inv(cov).ravel().tolist()]})


def concentrated(share: float | None, factor: float):
    """What makes an estimate of a group's binned moments: from its nearest rows up to `share` of them, or of all."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy(float)
        want = n.sum() if share is None else math.ceil(share * n.sum())
        below = np.cumsum(n) - n
        weight = np.clip((want - below) / n, 0, 1)  # the bin on the edge counts in part
        total = (weight * n).sum()
        s = np.stack(pdf["s"].to_numpy())
        mean = (weight[:, None] * s).sum(0) / total
        q = (weight[:, None] * np.stack(pdf["q"].to_numpy())).sum(0) / total
        cov = np.zeros((P, P))
        for (i, j), v in zip(PAIRS, q, strict=True):
            cov[i, j] = cov[j, i] = v - mean[i] * mean[j]
        return estimate(pdf["g"].iloc[0], int(pdf["start"].iloc[0]), int(pdf["whole"].iloc[0]), mean, factor * cov)

    return make


def moments(rows: DataFrame, kept: Column | None = None) -> DataFrame:
    """Per group, start and bin of distance: count, sums and sums of products of the rows."""
    d2 = distance(F.col("x"), F.col("center"), F.col("precision"))
    bins = F.least(F.greatest(F.floor(F.log2(d2 + 1e-9) * 16) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = rows.withColumn("d2", d2).withColumn("bin", bins)
    if kept is not None:
        rows = rows.where(kept).withColumn("bin", F.lit(0))
    return summed(rows)


def summed(rows: DataFrame) -> DataFrame:
    sums = [F.sum(F.col("x")[i]) for i in range(P)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in PAIRS]
    return rows.groupBy("g", "start", "bin").agg(F.count("*").alias("n"), F.max("whole").alias("whole"), F.array(*sums).alias("s"), F.array(*products).alias("q"))


def first_estimate(rows: DataFrame) -> DataFrame:
    """Coordinatewise medians and median absolute deviations, from histograms of width 0.01."""
    width = 0.01

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        center, spread = np.zeros(P), np.zeros(P)
        for i, part in pdf.groupby("pos"):
            v, n = part["bin"].to_numpy() * width, part["n"].to_numpy()
            order = np.argsort(v)
            v, n = v[order], n[order]
            center[i] = v[np.searchsorted(np.cumsum(n), n.sum() / 2)]
            gap = np.abs(v - center[i])
            order = np.argsort(gap)
            spread[i] = 1.4826 * gap[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
        whole = int(pdf.loc[pdf["pos"] == 0, "n"].sum())
        return estimate(pdf["g"].iloc[0], 0, whole, center, np.diag(spread**2))

    bins = rows.select("g", F.posexplode(F.transform("x", lambda v: F.floor(v / width))).alias("pos", "bin"))
    return bins.groupBy("g", "pos", "bin").agg(F.count("*").alias("n")).groupBy("g").applyInPandas(make, ESTIMATE)


def drawn_estimates(rows: DataFrame, first: DataFrame, count: int) -> DataFrame:
    """Mean and scatter of STARTS subsets of about DRAWN documents of each group, drawn by hashes of their vectors."""
    many = small_join(rows, first.select("g", F.col("n").alias("whole")), ["g"], count, how="inner")
    many = many.withColumn("start", F.explode(F.array(*(F.lit(k) for k in range(1, STARTS + 1)))))
    share = F.pmod(F.xxhash64("x", "start"), F.lit(1 << 40)) / float(1 << 40)
    some = many.where(share * F.col("whole") < DRAWN).withColumn("bin", F.lit(0))
    return summed(some).groupBy("g", "start").applyInPandas(concentrated(None, 1.0), ESTIMATE)


def fit(stats: DataFrame) -> DataFrame:
    """Estimates (g, n, center, precision, ...) of each group, from rows (lang, source, x) of the documents to learn from."""
    rows = stats.select(F.explode(F.array(*group_keys())).alias("g"), "x")
    model = stored(first_estimate(rows), "mcd-first", 1)
    count = model.count()
    cut, edge = chi_square_quantile(COVERED, P), chi_square_quantile(REWEIGHT, P)

    def step(model: DataFrame, share: float | None, factor: float, kept: Column | None = None) -> DataFrame:
        joined = small_join(rows, model.withColumnRenamed("n", "whole").drop("logdet"), ["g"], count * (STARTS + 1), how="inner")
        return stored(moments(joined, kept).groupBy("g", "start").applyInPandas(concentrated(share, factor), ESTIMATE), "mcd", 1)

    # the scatter of the nearest rows underestimates by the factor that the normal distribution gives
    concentrate = (COVERED, COVERED / chi_square_cdf(cut, P + 2))
    starts = stored(model.unionByName(drawn_estimates(rows, model, count)), "mcd-starts", 1)
    for _ in range(TRIED):
        starts = step(starts, *concentrate)
    names = [x.split()[0] for x in ESTIMATE.split(", ")]
    inner = F.struct("logdet", *(n for n in names if n != "logdet"))
    model = stored(starts.groupBy("g").agg(F.min(inner).alias("m")).select(*(F.col(f"m.{n}").alias(n) for n in names)), "mcd-best", 1)
    while True:
        made = step(model, *concentrate)
        both = made.select("g", inner.alias("new")).join(model.select("g", inner.alias("old")), "g")
        fall = both.agg(F.max(F.col("old.logdet") - F.col("new.logdet"))).first()[0]
        better = F.when(F.col("new.logdet") < F.col("old.logdet"), F.col("new")).otherwise(F.col("old"))
        model = stored(both.select(better.alias("m")).select(*(F.col(f"m.{n}").alias(n) for n in names)), "mcd-next", 1)
        if fall is None or fall <= SETTLED:
            break
    return step(model, None, REWEIGHT / chi_square_cdf(edge, P + 2), F.col("d2") <= edge)


def drawn(n: float, center: np.ndarray, cov: np.ndarray, wider: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Center and scatter of n documents together with PRIOR documents of the wider group's."""
    own, gap = n / (n + PRIOR), center - wider[0]
    return own * center + (1 - own) * wider[0], own * cov + (1 - own) * wider[1] + own * (1 - own) * np.outer(gap, gap)


def drawn_together(batches):
    """Of rows with a group and the estimates of all (0), its language (1) and itself (2): g, center, precision."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            made = None
            for n, center, precision in ((r.n0, r.center0, r.precision0), (r.n1, r.center1, r.precision1), (r.n2, r.center2, r.precision2)):
                if center is None:
                    continue
                mean, cov = np.array(center, float), np.linalg.inv(np.array(precision, float).reshape(P, P))
                made = (mean, cov) if made is None else drawn(n, mean, cov, made)
            out.append((r.g, None, None) if made is None else (r.g, made[0].tolist(), np.linalg.inv(raised(made[1])).ravel().tolist()))
        yield pd.DataFrame(out, columns=["g", "center", "precision"])


def own_estimates(docs: DataFrame, model: DataFrame) -> DataFrame:
    """g, center, precision of every language and source of the documents."""
    count = model.count()
    groups = docs.select(*(k.alias(f"g{2 - i}") for i, k in enumerate(group_keys()))).distinct()
    for i in (2, 1, 0):
        level = model.where(F.col("g").startswith(str(i))).select(F.col("g").alias(f"g{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("n", "center", "precision")))
        groups = small_join(groups, level, [f"g{i}"], count if i else 1)
    return groups.withColumnRenamed("g2", "g").mapInPandas(drawn_together, "g string, center array<double>, precision array<double>")


def with_distance(docs: DataFrame, model: DataFrame, x: str, to: str) -> DataFrame:
    """Adds the squared distance from the estimate of a document's language and source (null where there is no model)."""
    own = stored(own_estimates(docs, model), "mcd-own", 1)
    own = own.select(F.col("g").alias("__g"), F.struct("center", "precision").alias("__m"))
    out = small_join(docs.withColumn("__g", group_keys()[0]), own, ["__g"], own.count())
    return out.withColumn(to, distance(F.col(x), F.col("__m.center"), F.col("__m.precision"))).drop("__g", "__m")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the five base counts, base_failed, distance, kept.

    Null texts have no words (so they fail the base rules, as empty ones do); null languages and sources are groups
    of their own; rows of one doc_id are judged each for itself; an empty table gives no rows."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("lang", "source")), stats_column(text_bytes()).alias("m"))
    rows = stored(rows.select("doc_id", "lang", "source", "m.*").withColumn("base_failed", base_failed()), "quality-stats")
    model = fit(rows.where("not base_failed"))
    out = with_distance(rows, model, "x", "distance")
    return out.select("doc_id", *NAMES, "base_failed", verdict(F.col("base_failed"), F.col("distance")).alias("kept"), F.when(~F.col("base_failed"), F.col("distance")).alias("distance"))


def verdict(failed: Column, d2: Column) -> Column:
    return ~failed & (F.coalesce(d2, F.lit(0.0)) <= chi_square_quantile(REJECT, P))


def keep_passing(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; their statistics are made once and stored with them, and their
    texts aren't shuffled."""
    prepare(docs.sparkSession)
    names = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    rows = docs.select(F.struct("*").alias("row"), *names, stats_column(text_bytes()).alias("m")).where(~base_failed("m."))
    rows = stored(rows.select("row", "lang", "source", "m.x"), "quality-rows")
    out = with_distance(rows, fit(rows.select("lang", "source", "x")), "x", "d2").where(verdict(F.lit(False), F.col("d2")))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

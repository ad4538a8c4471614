"""The detection pipeline: raw records to alerts, in stages that each add columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ANOMALY_THRESHOLD, BANDS, DEFAULT_CRITICALITY, Bands, Settings
from ..operators import baseline, calibrate, iforest
from ..operators.alerts import alert_rows, explained
from ..operators.attack import with_techniques
from ..operators.correlate import correlated, slim
from ..operators.growing import Profile
from ..operators.ladders import FEATURE_NAMES, FEATURES, FLAGS, KEYS, NAMES, apply
from ..operators.normalize import normalize, parsed
from ..operators.signals import with_signals
from .session import prepare, stored


def named(rows: DataFrame) -> DataFrame:
    """Correlated records as normalised events with their flags and baseline keys."""
    prepare(rows.sparkSession)
    return apply(normalize(rows), NAMES, FLAGS, KEYS)


def flagged(raw: DataFrame) -> DataFrame:
    """Normalised, correlated events with their flags and baseline keys. Lines are parsed once and kept: children and
    parents both read them."""
    prepare(raw.sparkSession)
    return named(correlated(stored(slim(parsed(raw)), "parsed")))


def contextual(raw: DataFrame, batch: str | None = None, instant: bool = False) -> DataFrame:
    """Flagged events with their signals (`instant`: see `with_signals`)."""
    return with_signals(flagged(raw), batch, instant=instant)


def featured(events: DataFrame, profile: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Adds rarities and the 28 features; without a profile every rarity is one half. `sums`: of a profile that grows."""
    if profile is None:
        for k in baseline.READ_KINDS:
            events = events.withColumn(f"rarity_{k}", F.lit(0.5))
    else:
        events = baseline.with_rarity(events, profile, profile if sums is not None else None, sums)
    return apply(events, FEATURES)


def train(events: DataFrame, trees: int = iforest.TREES, sample: int = iforest.SAMPLE, least: int = 500, contamination: float | None = None) -> dict:
    """Profile, forest and calibration of a set of contextual events."""
    profile = baseline.counts(events)
    rows = featured(events, profile)
    if (n := rows.count()) < least:
        raise ValueError(f"{n} events are too few to train on; {least} are needed")
    forest = iforest.fit(rows, FEATURE_NAMES, trees=trees, sample=sample, contamination=contamination)
    scores = stored(iforest.with_raw_score(rows, forest).select("raw_score"), "raw-scores")  # scored once
    return {"profile": profile, "forest": forest, "calibration": calibrate.fit(scores, "raw_score", offset=forest["offset"])}


def learn(events: DataFrame, forest: dict, path: str, batch: int) -> dict:
    """Let a model grow by a batch of contextual events: its profile, then the calibration of its forest's scores under
    that profile. A batch that comes again changes nothing; nothing is read but the batch and the model's own tables."""
    spark = events.sparkSession
    profile = Profile(spark, f"{path}/profile")
    profile.add(events, batch)
    scores = iforest.with_raw_score(featured(events, profile.keys(), profile.sums()), forest)
    calibrate.add_batch(scores, "raw_score", f"{path}/scores", batch)
    return learnt(spark, forest, path)


def learnt(spark: SparkSession, forest: dict, path: str) -> dict:
    """The model as it has grown so far."""
    profile = Profile(spark, f"{path}/profile")
    calibration = calibrate.from_states(calibrate.read_states(spark, f"{path}/scores"), offset=forest["offset"])
    return {"profile": profile.keys(), "sums": profile.sums(), "forest": forest, "calibration": calibration}


#: Hosts of a table of criticalities up to which it is broadcast.
FEW_HOSTS = 100_000


def with_criticality(rows: DataFrame, hosts: dict[str, float] | DataFrame | None) -> DataFrame:
    """Adds the criticality of each event's host: of a table (host, criticality) or settings; else the default. Of a host
    that a table has twice, the highest counts."""
    if hosts is None or isinstance(hosts, dict) and not hosts:
        return rows.withColumn("criticality", F.lit(DEFAULT_CRITICALITY))
    if isinstance(hosts, dict):
        hosts = rows.sparkSession.createDataFrame([(h, float(v)) for h, v in hosts.items()], "host string, criticality double")
    known = hosts.groupBy("host").agg(F.max(F.col("criticality").cast("double")).alias("criticality"))
    known = F.broadcast(known) if known.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS else known
    return rows.join(known, "host", "left").withColumn("criticality", F.coalesce("criticality", F.lit(DEFAULT_CRITICALITY)))


def assessed(rows: DataFrame, calibration: calibrate.Calibration, weights: dict | None = None, hosts: dict[str, float] | DataFrame | None = None, bands: Bands = BANDS, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Featured events with a raw_score: adds anomaly, techniques, risk and explanation."""
    rows = with_criticality(calibrate.with_anomaly(rows, "raw_score", calibration, threshold), hosts)
    return explained(with_techniques(rows), weights, bands)


def detect(raw: DataFrame, model: dict, scored_at: str, weights: dict | None = None, hosts: dict[str, float] | DataFrame | None = None, correlated: bool = False, settings: Settings | None = None) -> DataFrame:
    """Alert rows of raw records (or, `correlated`, of parsed ones with the enrichment of their event) under a model.
    `settings` gives weights, hosts, bands and threshold, where they aren't given themselves."""
    settings = settings or Settings()
    events = with_signals(named(raw)) if correlated else contextual(raw)
    rows = iforest.with_raw_score(featured(events, model["profile"], model.get("sums")), model["forest"])
    rows = assessed(rows, model["calibration"], weights or settings.weights, settings.hosts if hosts is None else hosts, settings.bands, settings.threshold)
    return alert_rows(rows, scored_at, model.get("version", "none"))


def proxy_score():
    """A raw score without a forest: minus the mean of the rarities. It is what SQL can follow exactly."""
    return F.round(-(F.col("rarity_host_exe") + F.col("rarity_user_exe") + F.col("rarity_exe") + F.col("rarity_user_host")) / 4, 6)


def proxy_assessed(raw: DataFrame) -> DataFrame:
    """The whole pipeline with the proxy score, its own events as the baseline."""
    rows = proxy_featured(stored(contextual(raw), "contextual"))
    return assessed(rows, calibrate.fit(rows, "raw_score"))


def proxy_featured(events: DataFrame) -> DataFrame:
    return stored(featured(events, baseline.counts(events)).withColumn("raw_score", proxy_score()), "featured")

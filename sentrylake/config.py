"""Settings: risk weights, severity bands, criticality of hosts, and the knobs of a deployment."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

# The default weights of the composite risk score.
RISK_WEIGHTS = {
    "impact": {"privilege": 0.40, "confidentiality": 0.25, "integrity": 0.25, "availability": 0.10},
    "exploitability": {"privilege_required": 0.30, "attack_complexity": 0.25, "auth_context": 0.20, "remote": 0.25},
    "technical_severity": {"impact": 0.6, "exploitability": 0.4},
    "technique_floor": {"base": 0.35, "scale": 0.6},
    "context_modifier": {"base": 0.45, "anomaly": 0.35, "rarity": 0.15, "technique": 0.15, "asset": 0.20, "min": 0.25, "max": 1.30},
}

# Least score of each severity, the highest first; below the last: informational.
BANDS = (("critical", 80), ("high", 60), ("medium", 40), ("low", 20))
SEVERITIES = ("critical", "high", "medium", "low", "informational")
DEFAULT_CRITICALITY = 0.5
ANOMALY_THRESHOLD = 0.98


Bands = tuple[tuple[str, int], ...]


class BadSettings(ValueError):
    """Settings that can't be used; the message names each."""


def flat_weights() -> dict[str, float]:
    """The default weights by their dotted names (`impact.privilege`)."""
    return {f"{group}.{name}": value for group, inner in RISK_WEIGHTS.items() for name, value in inner.items()}


def weights(changes: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """The risk weights with some of them changed, by their dotted names; BadSettings for unknown names and non-numbers."""
    flat = flat_weights()
    wrong = [f"{k} is unknown" for k in changes if k not in flat]
    wrong += [f"{k} is no number of 0 or more" for k, v in changes.items() if isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0]
    if wrong:
        raise BadSettings("; ".join(wrong))
    out: dict[str, dict[str, float]] = {}
    for name, value in {**flat, **changes}.items():
        group, _, part = name.partition(".")
        out.setdefault(group, {})[part] = float(value)
    return out


def _dotted(tree: object, path: Iterable[str] = ()) -> dict[str, object]:
    if not isinstance(tree, dict):
        return {".".join(path): tree}
    return {k: v for name, inner in tree.items() for k, v in _dotted(inner, (*path, str(name))).items()}


def bands(**least: int) -> Bands:
    """The severities' least scores with some of them changed (high=70); BadSettings unless they fall from critical to low
    inside 0 to 100."""
    if unknown := set(least) - {name for name, _ in BANDS}:
        raise BadSettings(f"no such severity: {', '.join(sorted(unknown))}")
    out = tuple((name, least.get(name, score)) for name, score in BANDS)
    scores = [score for _, score in out]
    if any(isinstance(s, bool) or not isinstance(s, int) for s in scores) or not 100 >= scores[0] > scores[1] > scores[2] > scores[3] > 0:
        raise BadSettings(f"severities have to fall from critical to low: {', '.join(f'{n} {s}' for n, s in out)}")
    return out


@dataclass(frozen=True)
class Settings:
    """What a deployment can set. `read` takes each field from a variable of its name in capitals, with a prefix; what is
    wrong there keeps its default and is named in `problems`, so that a service starts and reports it."""

    # fixed values: the defaults of the numbers below
    threshold: float = ANOMALY_THRESHOLD
    batch_rows: int = 1000
    every_seconds: int = 300
    trees: int = 300
    sample: int = 4096
    bands: Bands = BANDS
    weights: dict = field(default_factory=lambda: weights({}))
    hosts: dict = field(default_factory=dict)
    problems: tuple[str, ...] = ()

    @classmethod
    def read(cls, variables: Mapping[str, str], prefix: str = "SENTRYLAKE_") -> Settings:
        """weights: a JSON file of weights to change; hosts: JSON text of host names and criticalities; bands: JSON text of
        severities and their least scores."""
        found, problems = {}, []
        readers = {"float": float, "int": lambda t: int(float(t)), "weights": weights_of_file, "hosts": criticalities, "bands": bands_of}
        for f in fields(cls):
            text = variables.get(prefix + f.name.upper(), "").strip()
            reader = readers.get(f.name) or readers.get(f.type)
            if not text or reader is None:
                continue
            try:
                found[f.name] = reader(text)
            except (ValueError, OSError) as e:
                problems.append(f"{prefix}{f.name.upper()}: {e}")
        return cls(**found, problems=tuple(problems))


def bands_of(text: str) -> Bands:
    """Bands of JSON text; BadSettings if it is something else."""
    try:
        got = json.loads(text)
    except json.JSONDecodeError as e:
        raise BadSettings(f"no JSON: {e}") from None
    if not isinstance(got, dict):
        raise BadSettings("it has to be an object of severities and least scores")
    return bands(**got)


def weights_of_file(path: str) -> dict[str, dict[str, float]]:
    """The weights with those of a JSON file laid over them; BadSettings or OSError if it can't be used."""
    try:
        return weights(_dotted(json.loads(Path(path).read_text())))
    except json.JSONDecodeError as e:
        raise BadSettings(f"{path} is no JSON: {e}") from None


def criticalities(text: str) -> dict[str, float]:
    """Host -> criticality (0 to 1) of JSON text; BadSettings if it is something else."""
    try:
        got = json.loads(text)
    except json.JSONDecodeError as e:
        raise BadSettings(f"no JSON: {e}") from None
    if not isinstance(got, dict) or not all(isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1 for v in got.values()):
        raise BadSettings("it has to be an object of host names and numbers from 0 to 1")
    return {host: float(v) for host, v in got.items()}

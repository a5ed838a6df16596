"""Severity, CVSS and confidence columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores and weights of severities.
SCORES = {"NONE": 0.0, "LOW": 2.0, "MEDIUM": 5.5, "MODERATE": 5.5, "HIGH": 8.0, "CRITICAL": 9.5, "UNKNOWN": 0.0}
WEIGHTS = {"CRITICAL": 5.0, "HIGH": 3.0, "MODERATE": 2.0, "MEDIUM": 2.0, "LOW": 1.0}
RANKS = {"CRITICAL": 4, "HIGH": 3, "MODERATE": 2, "MEDIUM": 2, "LOW": 1}
NUMBERS = {"CRITICAL": 9.0, "HIGH": 7.5, "LOW": 3.0}


def _map(key: Column, values: dict, default) -> Column:
    found = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(found, key), F.lit(default))


def _level(severity: Column) -> Column:
    return F.upper(F.trim(F.coalesce(severity, F.lit(""))))


def severity_score(severity: Column) -> Column:
    return _map(_level(severity), SCORES, 0.0)


def severity_weight(severity: Column) -> Column:
    return _map(_level(severity), WEIGHTS, 0.0)


def severity_rank(severity: Column) -> Column:
    return _map(_level(severity), RANKS, 0)


def severity_number(severity: Column) -> Column:
    """Critical 9, high 7.5, low 3, anything else 5."""
    return _map(_level(severity), NUMBERS, 5.0)


def node_severity(cves: Column) -> Column:
    """Sum of weights over an array of struct(severity); where that is 0, 1.2 for each CVE."""
    total = F.aggregate(cves, F.lit(0.0), lambda s, c: s + severity_weight(c["severity"]))
    return F.when(total == 0, F.size(cves) * F.lit(1.2)).otherwise(total)


def cvss31(vector: Column) -> Column:
    """CVSS v3.1 base score of a vector string; 0 for other strings, null for an incomplete vector."""
    part = F.str_to_map(F.substring(vector, F.lit(10), F.length(vector)), F.lit("/"), F.lit(":"))
    get = lambda name, values: F.try_element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), F.try_element_at(part, F.lit(name)))
    # Fixed values of the CVSS v3.1 specification.
    wide = F.try_element_at(part, F.lit("S")) == "C"
    rights = F.when(wide, get("PR", {"N": 0.85, "L": 0.68, "H": 0.5})).otherwise(get("PR", {"N": 0.85, "L": 0.62, "H": 0.27}))
    ease = 8.22 * get("AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}) * get("AC", {"L": 0.77, "H": 0.44}) * rights * get("UI", {"N": 0.85, "R": 0.62})
    loss = {"N": 0.0, "L": 0.22, "H": 0.56}
    iss = 1 - (1 - get("C", loss)) * (1 - get("I", loss)) * (1 - get("A", loss))
    impact = F.when(wide, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    base = F.when(impact <= 0, 0.0).when(wide, F.least(1.08 * (impact + ease), F.lit(10.0))).otherwise(F.least(impact + ease, F.lit(10.0)))
    # rounding up to a tenth, on whole hundred-thousandths, as the specification has it
    return F.when(F.coalesce(vector.startswith("CVSS:3.1/"), F.lit(False)), F.ceil(F.round(base * 100000) / 10000) / 10).otherwise(0.0)


def best_metric(metrics: Column) -> Column:
    """Of array<struct(source, type, score, vector)>: the last primary or NVD metric, else that of the highest score."""
    primary = F.filter(metrics, lambda m: (m["type"] == "Primary") | (m["source"] == "nvd@nist.gov"))
    ranked = F.array_max(F.transform(metrics, lambda m: F.struct(m["score"].alias("score"), m["vector"].alias("vector"))))
    return F.when(F.size(primary) > 0, F.struct(F.element_at(primary, -1)["score"].alias("score"), F.element_at(primary, -1)["vector"].alias("vector"))).otherwise(ranked)


def first_cvss(severity: Column) -> Column:
    """The vector of the first array<struct(type, score)> entry of a CVSS type."""
    return F.try_element_at(F.filter(severity, lambda s: F.upper(s["type"]).startswith("CVSS")), F.lit(1))["score"]


def similarity(distance: Column) -> Column:
    return 1 / (1 + F.abs(distance) + 1e-8)


# Fixed values of the confidence in an origin: the base by method (and without one), what is added over a similarity, up to so
# many candidates (and beyond), and for sequences of versions; and the bounds.
ORIGIN_BASE, ORIGIN_OTHER = {"vector_temporal": 0.70, "temporal_window": 0.50, "conservative": 0.30}, 0.20
ORIGIN_SIMILARITY = ((0.8, 0.15), (0.6, 0.10), (0.4, 0.05))
ORIGIN_CANDIDATES, ORIGIN_MANY = ((0, 0.0), (3, 0.10), (10, 0.05), (30, 0.0)), -0.05
ORIGIN_LONG, ORIGIN_SINGLE = (5, 0.05), -0.05
ORIGIN_BOUNDS = (0.1, 0.95)
# Fixed values of the confidence in a propagation: the loss by step, the worth of days (first, last, inside, later, else), the
# weights of path, time and upstream nodes, and the number of these that is enough.
STEP_LOSS, DAYS, PROPAGATION_WEIGHTS, ENOUGH_UPSTREAM = 0.15, (1, 365, 1.0, 0.8, 0.5), (0.5, 0.3, 0.2), 3


def _kept(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def origin_confidence(method: Column, distance: Column, n_candidates: Column, n_versions: Column) -> Column:
    """Of an origin found by a method: base by method, changed by similarity, candidates and versions, within bounds."""
    sim = similarity(distance)
    parts = [
        F.coalesce(*(F.when(method == name, value) for name, value in ORIGIN_BASE.items()), F.lit(ORIGIN_OTHER)),
        F.coalesce(*(F.when(sim > over, value) for over, value in ORIGIN_SIMILARITY)),
        F.coalesce(*(F.when(n_candidates <= most, value) for most, value in ORIGIN_CANDIDATES), F.when(n_candidates.isNotNull(), ORIGIN_MANY)),
        F.coalesce(F.when(n_versions >= ORIGIN_LONG[0], ORIGIN_LONG[1]), F.when(n_versions == 1, ORIGIN_SINGLE)),
    ]
    return _kept(reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0.0)) for x in parts)), *ORIGIN_BOUNDS)


def propagation_confidence(path_length: Column, days: Column, n_upstream: Column) -> Column:
    first, last, inside, later, other = DAYS
    path = F.greatest(F.lit(0.0), 1 - (path_length - 1) * F.lit(STEP_LOSS))
    time = F.coalesce(F.when(days.between(first, last), inside), F.when(days > last, later), F.lit(other))
    return _kept(reduce(lambda a, b: a + b, (w * x for w, x in zip(PROPAGATION_WEIGHTS, (path, time, F.least(F.lit(1.0), n_upstream / ENOUGH_UPSTREAM))))), 0.0, 1.0)

"""Column functions on numbers, times and JSON: calibrators, priors, decision tables, bit vectors. All run in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The decision tables.
#: Commercial intent and ownership to action; ``*`` stands for all that are not named before it.
POLICY = {
    ("paid", "thirdParty"): "autoSkipEligible", ("paid", "guest"): "detectOnly", ("paid", "*"): "logOnly",
    ("owned", "show"): "detectOnly", ("owned", "network"): "detectOnly", ("owned", "*"): "logOnly",
    ("affiliate", "*"): "detectOnly", ("organic", "*"): "suppress",
    ("unknown", "unknown"): "detectOnly", ("unknown", "*"): "logOnly",
}
#: Content class to eligibility with strong and with weak evidence.
ELIGIBILITY = {
    "thirdPartyPaid": ("autoSkipEligible", "markOnly"), "affiliatePaid": ("markOnly", "markOnly"), "networkPromo": ("userConfigurable", "markOnly"),
    "showPromo": ("userConfigurable", "markOnly"), "ownedProduct": ("markOnly", "markOnly"), "editorialMention": ("ineligible", "ineligible"), "unknown": ("markOnly", "ineligible"),
}
CERTAINTY = {"weak": 0.3, "moderate": 0.6, "strong": 0.9}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 below ``low``, then linear up to 1 at ``high``; falling if ``high`` is the smaller."""
    return clamp((x - F.lit(low)) / F.lit(high - low), 0.0, 1.0)


def platt(x: Column, a: float, b: float) -> Column:
    """Sigmoid calibration of a raw score, which is clamped to 0..1; 0 for what is no number."""
    bad = F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(1 / (1 + F.exp(F.lit(a) * clamp(x, 0.0, 1.0) + F.lit(b))))


def monotone(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through knots in ascending order; clamped outside; 0 for what is no number."""
    out = F.when(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")), 0.0).when(x <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + (x - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0))
    return out.otherwise(knots[-1][1])


def duration_prior(d: Column, low: float = 30.0, high: float = 90.0, floor: float = 0.75, bumper: float = 0.90, peak: float = 1.10, shoulder: float = 0.95, shortest: float = 5.0) -> Column:
    """Multiplier by duration: a floor, a rise from the bumper to the peak, the peak, and two slopes back to the floor."""
    slope = lambda x0, x1, y0, y1: F.lit(y0) + (d - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0)
    out = F.when(d.isNull() | F.isnan(d) | (d < shortest), floor).when(d < low, slope(shortest, low, bumper, peak)).when(d <= high, peak)
    return out.when(d <= 2 * high, slope(high, 2 * high, peak, shoulder)).when(d <= 3 * high, slope(2 * high, 3 * high, shoulder, floor)).otherwise(floor)


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 1800, "under30m").when(seconds <= 3600, "to60m").when(seconds <= 5400, "to90m").otherwise("over90m")


def execution_condition(network: Column, battery: Column, charging: Column, thermal: Column, low_power: Column) -> Column:
    """constrained if any of its predicates holds, else favorable if all of its hold, else mixed. A negative battery level is unknown."""
    constrained = (network == "cellular") | ((battery >= 0) & (battery < 0.2) & ~charging) | thermal.isin("serious", "critical") | low_power
    favorable = (network == "wifi") & (charging | (battery >= 0.5)) & thermal.isin("nominal", "fair")
    return F.when(constrained, "constrained").when(favorable, "favorable").otherwise("mixed")


def rule_score(lexical: Column, rms: Column, flux: Column, music: Column, speaker: Column, prior: Column) -> Column:
    """Weighted parts through a sigmoid of steepness 8 around .25."""
    total = 0.40 * lexical + 0.20 * rms + 0.15 * flux + 0.10 * music + 0.05 * speaker + 0.10 * prior
    return 1 / (1 + F.exp(-8.0 * (total - 0.25)))


def decay(age: Column, horizon: float, floor: float) -> Column:
    """Linear decay to a floor at the horizon."""
    return F.greatest(F.lit(floor), 1 - age / F.lit(horizon) * F.lit(1 - floor))


def beta_mean(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, a / (a + b)).otherwise(0.0)


def beta_variance(a: Column, b: Column) -> Column:
    n = a + b
    return F.when(n > 0, a * b / (n * n * (n + 1))).otherwise(0.0)


def composite(text: Column, acoustic: Column, marker: Column, reliability: Column) -> Column:
    """Blend .5, .3 and .2 of the similarities that are there; the text's weight goes with its reliability, none below .3."""
    sure = clamp(reliability, 0.0, 1.0)
    weights = [F.when(text.isNotNull() & (sure >= 0.3), 0.5 * sure).otherwise(0.0), F.when(acoustic.isNotNull(), 0.3).otherwise(0.0), F.when(marker.isNotNull(), 0.2).otherwise(0.0)]
    parts = [w * F.coalesce(x, F.lit(0.0)) for w, x in zip(weights, (text, acoustic, marker), strict=True)]
    total = weights[0] + weights[1] + weights[2]
    return F.when(total > 0, (parts[0] + parts[1] + parts[2]) / total).otherwise(0.0)


def pack_bits(flags: Column) -> Column:
    """Up to 64 booleans as one long, the first as the highest bit."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x.cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def gap_confidence(left: Column, right: Column) -> Column:
    return 1 - F.exp(-F.least(left, right) / 60)


def least_gap(seconds: Column, per_frame: Column) -> Column:
    """Frames of a least gap, one at least; halves go to the even number."""
    return F.greatest(F.lit(1).cast("long"), F.rint(seconds / per_frame).cast("long"))


def policy_action(intent: Column, ownership: Column) -> Column:
    out = F.when(F.lit(False), "")
    for (i, o), action in POLICY.items():
        out = out.when((intent == i) if o == "*" else (intent == i) & (ownership == o), action)
    return out.otherwise("logOnly")


def eligibility(content: Column, strong: Column) -> Column:
    out = F.when(F.lit(False), "")
    for c, (with_strong, with_weak) in ELIGIBILITY.items():
        out = out.when(content == c, F.when(strong, with_strong).otherwise(with_weak))
    return out


def capped(source: Column, weight: Column, caps: Mapping[str, float]) -> Column:
    """The weight, cut at its source's cap; nothing goes to others."""
    out = F.when(F.lit(False), 0.0)
    for s, cap in caps.items():
        out = out.when(source == s, F.least(weight, F.lit(cap)))
    return out.otherwise(weight)


def example_bucket(transcript: Column, fm: Column, certainty: Column, lexical: Column, lexical_fired: Column, classifier: Column, reverted: Column, reported: Column, eligible: Column) -> Column:
    """disagreement, uncertain, positive or negative: the first rule that holds."""
    clash = (fm & reverted) | (~fm & reported) | ((transcript == "good") & lexical_fired & (fm != lexical))
    some = (fm & (certainty >= 0.5)) | lexical | (classifier >= 0.6) | reverted | reported
    unsure = (transcript == "unusable") | ((transcript != "good") & ~some & ~eligible)
    yes = ((fm & (certainty >= 0.7)) | eligible) & ~reverted
    return F.when(clash, "disagreement").when(unsure, "uncertain").when(yes, "positive").otherwise("negative")


def flip_value(confidence: Column, gain: Column, cost: Column) -> Column:
    """Expected value of a look: chance that a decision flips, times gain, by cost."""
    return (1 - F.abs(2 * confidence - 1)) * gain / cost


def certainty(payload: Column) -> Column:
    """The certainty of a JSON payload: by band, else as a number, else 0."""
    raw = F.get_json_object(payload, "$.certainty")
    out = F.when(F.lit(False), 0.0)
    for band, value in CERTAINTY.items():
        out = out.when(raw == band, value)
    return out.otherwise(F.coalesce(F.when(raw.rlike("^-?[0-9]+([.][0-9]+)?$"), raw.try_cast("double")), F.lit(0.0)))


def scope_span(scope: Column) -> Column:
    """``exactTimeSpan:<id>:<start>:<end>`` as a struct; null for any other scope or an end that is not behind the start."""
    part = F.split(scope, ":")
    start, end = F.get(part, F.lit(2)).try_cast("double"), F.get(part, F.lit(3)).try_cast("double")
    good = (F.size(part) == 4) & (F.get(part, F.lit(0)) == "exactTimeSpan") & (end > start)
    return F.when(good, F.struct(F.get(part, F.lit(1)).alias("id"), start.alias("start"), end.alias("end")))


def version_hash(texts: Column) -> Column:
    """First 16 bytes of SHA-256 over texts in order, each behind its length in four bytes."""
    framed = F.transform(texts, lambda t: F.concat(F.lpad(F.hex(F.octet_length(t).cast("long")), 8, F.lit("0")), F.hex(F.encode(t, "UTF-8"))))
    return F.substring(F.sha2(F.unhex(F.array_join(framed, "")), 256), 1, 32)

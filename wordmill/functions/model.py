"""Language-model arithmetic: smoothing, calibration, lanes, policy numbers; and packed morphology."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Every number that ranking and policy use. override() takes known names only."""

    add_k: float = 0.5
    vocabulary: float = 100_000.0
    bigram_weight: float = 0.6
    language_weight: float = 1.0
    floor_frequency: float = 2.0
    possessive_share: float = 0.1
    lane_switch: float = 0.08
    lane_least: float = 0.1
    lane_most: float = 0.9
    lane_floor: float = -1.25
    lane_dead: float = 1.0
    lane_cap: float = 1.1
    sentence_relax: float = 0.2
    margin: float = 1.15
    least_z: float = -2.5
    junk_z: float = -1.0
    junk_factor: float = 3.0
    most_cost: float = 6.0
    far_edits: int = 3
    split_margin: float = 2.5
    restore_margin: float = 0.5
    restore_ratio: float = 10.0
    personal_base: float = 2.0
    personal_slope: float = 0.75
    personal_cap: float = 6.0
    touch_prior: float = 50.0
    touch_least: int = 30

    def override(self, **values: float) -> Settings:
        if unknown := set(values) - {f.name for f in fields(self)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **values)


SETTINGS = Settings()


def unigram_p(freq: Column, total: Column, s: Settings = SETTINGS) -> Column:
    return (F.coalesce(freq, F.lit(0)) + s.add_k) / (total + s.add_k * s.vocabulary)


def bigram_p(pair: Column, before: Column, p: Column, s: Settings = SETTINGS) -> Column:
    """Interpolated with the unigram; an unseen first word leaves the unigram alone."""
    return F.when(F.coalesce(before, F.lit(0)) > 0, s.bigram_weight * F.coalesce(pair, F.lit(0)) / before + (1 - s.bigram_weight) * p).otherwise(p)


def z_score(p: Column, total: Column, mean: Column, spread: Column, s: Settings = SETTINGS) -> Column:
    """ln p against a language's mean and spread of ln(frequency + k)."""
    return (F.log(p) - (mean - F.log(total + s.add_k * s.vocabulary))) / spread


def lane_evidence(first: Column, second: Column, s: Settings = SETTINGS) -> Column:
    """Nats for the first of two languages, from a word's z in each; missing is the floor."""
    margin = F.greatest(F.coalesce(first, F.lit(s.lane_floor)), F.lit(s.lane_floor)) - F.greatest(F.coalesce(second, F.lit(s.lane_floor)), F.lit(s.lane_floor))
    return F.signum(margin) * F.least(F.greatest(F.lit(0.0), F.abs(margin) - s.lane_dead), F.lit(s.lane_cap))


def lane_step(p: Column, evidence: Column, s: Settings = SETTINGS) -> Column:
    """The posterior after a word: switch, weigh, clamp."""
    moved = (1 - s.lane_switch) * p + s.lane_switch * (1 - p)
    odds = moved / (1 - moved) * F.exp(evidence)
    return F.least(F.greatest(odds / (1 + odds), F.lit(s.lane_least)), F.lit(s.lane_most))


def lane_relax(p: Column, s: Settings = SETTINGS) -> Column:
    """A sentence's end draws the posterior to the middle."""
    return p + s.sentence_relax * (0.5 - p)


def blend(p: Column, first: Column, second: Column, boost: Column | None = None) -> Column:
    """log-sum-exp of two lanes' z, and what is personal; with a boost no lane counts below -0.5."""
    boost = F.lit(0.0) if boost is None else boost
    low = F.when(boost > 0, -0.5).otherwise(float("-inf"))
    a, b = F.log(p) + F.greatest(first, low), F.log(1 - p) + F.greatest(second, low)
    most = F.greatest(a, b)
    return most + F.log(F.exp(a - most) + F.exp(b - most)) + boost


def personal_boost(count: Column, pair: Column, s: Settings = SETTINGS) -> Column:
    one = F.when(count > 0, F.least(s.personal_base + s.personal_slope * F.log1p(count), F.lit(s.personal_cap))).otherwise(0.0)
    return one + F.least(2.0 * F.log1p(F.coalesce(pair, F.lit(0))), F.lit(s.personal_cap))


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def fold_price(p: Column) -> Column:
    """What restoring an accent costs at a lane's posterior."""
    return F.greatest(F.lit(0.02), 0.35 * (1 - smoothstep(p, 0.5, 0.75)))


def shrunk_offset(mean: Column, n: Column, s: Settings = SETTINGS) -> Column:
    return F.when(n >= s.touch_least, n / (n + s.touch_prior) * mean)


# Morphology: a bundle packs case, gender, number, definiteness, person, tense and mood into 16 bits.
FIELDS = {"case": (0, 3), "gender": (3, 2), "number": (5, 2), "definite": (7, 1), "person": (8, 2), "tense": (10, 2), "mood": (12, 3)}
CASES = (("ÞGF", 3), ("ÞF", 2), ("NF", 1), ("EF", 4))  # longer marks first: one holds another


def parse_mark(mark: Column) -> Column:
    """The bundle of a paradigm mark such as ÞGFFTgr."""
    def pick(rules) -> Column:
        out = F.lit(0)
        for text, value in reversed(rules):
            out = F.when(mark.contains(text), value).otherwise(out)
        return out

    parts = {
        "case": pick(CASES), "gender": F.when(mark.contains("KVK"), 2).when(mark.contains("KK"), 1).when(mark.contains("HK"), 3).otherwise(0),
        "number": pick((("FT", 2), ("ET", 1))), "definite": F.when(mark.contains("gr"), 1).otherwise(0), "person": pick((("1P", 1), ("2P", 2), ("3P", 3))),
        "tense": F.when(mark.contains("ÞT"), 2).when(mark.contains("NT"), 1).otherwise(0), "mood": pick((("VH", 2), ("BH", 3), ("NH", 4), ("FH", 1))),
    }
    return pack(parts)


def pack(parts: dict[str, Column]) -> Column:
    out = F.lit(0)
    for name, value in parts.items():
        at, width = FIELDS[name]
        out = out.bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit((1 << width) - 1)).cast("int"), at))
    return out.cast("int")


def unpack(bundle: Column, name: str) -> Column:
    at, width = FIELDS[name]
    return F.shiftright(bundle, at).bitwiseAND(F.lit((1 << width) - 1))


def with_case(bundle: Column, case: int) -> Column:
    return bundle.bitwiseAND(F.lit(0xFFFF ^ 7)).bitwiseOR(F.lit(case))


def bundle_text(bundle: Column) -> Column:
    return F.concat_ws(":", *(F.concat(F.lit(n[0]), unpack(bundle, n).cast("string")) for n in FIELDS))

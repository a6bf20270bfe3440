"""Tunables of the matcher and of the gates, as data."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class AmountBands:
    tip_abs: int = 500
    tip_rel: float = 0.15
    partial_abs: int = 2000
    partial_rel: float = 0.20
    fuel_rel: float = 0.20
    fx_rounding: int = 2
    cashback_abs: int = 500


@dataclass(frozen=True)
class MatchConfig:
    max_lead_us: int = 48 * HOUR_US
    max_lag_us: int = 168 * HOUR_US
    abs_tolerance: int = 50
    rel_tolerance: float = 0.02
    bands: AmountBands = field(default_factory=AmountBands)
    min_confidence: float = 0.82
    ambiguity_margin: float = 0.02
    min_merchant: float = 0.55
    distinguish_amount: float = 0.01
    distinguish_merchant: float = 0.01
    distinguish_temporal_sec: int = 120
    weight_amount: float = 0.42
    weight_temporal: float = 0.23
    weight_merchant: float = 0.30
    weight_mcc: float = 0.05
    source_boost: tuple[tuple[str, float], ...] = (("email", 1.0), ("ocr", 1.0), ("pos", 1.0))
    #: Candidates pass at these multiples of the tolerances.
    loose_abs_factor: int = 4
    loose_rel_factor: int = 2
    bucket_minor: int = 500
    temporal_decay: float = 0.35

    @property
    def loose_abs(self) -> int:
        return self.abs_tolerance * self.loose_abs_factor

    @property
    def loose_rel(self) -> float:
        return self.rel_tolerance * self.loose_rel_factor

    def as_json(self) -> str:
        """Compact JSON in the fixed field order, durations in nanoseconds."""
        plain = lambda x: int(x) if float(x).is_integer() else x
        b = self.bands
        fields = {
            "MaxReceiptLead": self.max_lead_us * 1000, "MaxReceiptLag": self.max_lag_us * 1000, "AbsAmountTolerance": self.abs_tolerance, "RelAmountTolerance": self.rel_tolerance,
            "AmountBands": {
                "TipAbsMinor": b.tip_abs, "TipRel": b.tip_rel, "PartialCaptureAbsMinor": b.partial_abs, "PartialCaptureRel": b.partial_rel,
                "FuelPreAuthRel": b.fuel_rel, "FXRoundingMinor": b.fx_rounding, "CashbackAbsMinor": b.cashback_abs,
            },
            "MinConfidence": self.min_confidence, "AmbiguityMargin": self.ambiguity_margin, "MinMerchantForCandidate": self.min_merchant,
            "DistinguishAmountEpsilon": self.distinguish_amount, "DistinguishMerchantEpsilon": self.distinguish_merchant, "DistinguishTemporalSecs": self.distinguish_temporal_sec,
            "WeightAmount": self.weight_amount, "WeightTemporal": self.weight_temporal, "WeightMerchant": self.weight_merchant, "WeightMCC": self.weight_mcc,
            "SourceBoost": dict(self.source_boost),
        }
        flat = lambda v: {k: flat(x) for k, x in v.items()} if isinstance(v, dict) else plain(v)
        return json.dumps(flat(fields), separators=(",", ":"))

    def fingerprint(self) -> str:
        return hashlib.sha256(self.as_json().encode()).hexdigest()


@dataclass(frozen=True)
class GateThresholds:
    max_fmr: float = 0.005
    min_recall: float = 0.85
    min_hard_recall: float = 0.70
    min_conflict_correctness: float = 0.90
    max_conflict_rate: float = 0.05
    hard_classes: tuple[str, ...] = ("ambiguous", "near_duplicate", "merchant_mangling", "timezone_shift", "settlement_delay")
    crowded_classes: tuple[str, ...] = ("ambiguous", "duplicate_receipt", "density_stress", "generated_ambiguous")


@dataclass(frozen=True)
class SmokeThresholds:
    min_exact_precision: float = 0.90
    min_exact_recall: float = 0.90
    min_bearing_precision: float = 0.97
    min_bearing_recall: float = 0.92

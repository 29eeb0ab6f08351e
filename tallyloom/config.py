"""Rules and thresholds as frozen values, checked when they are made and captured into plans."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class FuzzyRule:
    fields: tuple[str, ...]
    field_map: dict[str, str] = field(default_factory=dict)
    date_window_days: int = 3
    min_similarity_score: float = 0.80

    def __post_init__(self) -> None:
        if not 0 <= self.min_similarity_score <= 1:
            raise ValueError("min_similarity_score must lie in [0, 1]")
        if not isinstance(self.date_window_days, int) or isinstance(self.date_window_days, bool) or self.date_window_days < 0:
            raise ValueError("date_window_days must be a non-negative integer")


@dataclass(frozen=True)
class PairRule:
    """How records of one type are linked to another type."""

    source_type: str
    target_type: str
    exact_keys: tuple[str, str]
    composite: tuple[str, ...]
    fuzzy: FuzzyRule
    amount_tolerance_pct: float = 0.0

    def __post_init__(self) -> None:
        if not 0 <= self.amount_tolerance_pct <= 1:
            raise ValueError("amount_tolerance_pct must lie in [0, 1]")


# Identifiers, rule keys, windows, scores and confidences of the matching contract.
ENTITY_ID = {"transaction": "transaction_id", "email": "message_id", "calendar_event": "event_id"}
ENTITY_DATE = {"transaction": "date", "email": "received_at", "calendar_event": "start_time"}
CONFIDENCE = {"tier1_exact": 1.0, "tier2_composite": 0.90}
FUZZY_FLOOR = 0.50
RULES = {
    ("transaction", "email"): PairRule("transaction", "email", ("transaction_id", "message_id"), ("merchant_name", "subject", "date"), FuzzyRule(("merchant_name", "name"), {"merchant_name": "subject", "name": "subject"}, 3, 0.80), 0.001),
    ("transaction", "calendar_event"): PairRule("transaction", "calendar_event", ("transaction_id", "event_id"), ("merchant_name", "subject", "date"), FuzzyRule(("merchant_name", "name"), {"merchant_name": "subject", "name": "subject"}, 1, 0.80), 0.001),
    ("email", "calendar_event"): PairRule("email", "calendar_event", ("message_id", "event_id"), ("subject", "start_time"), FuzzyRule(("subject",), {}, 1, 0.75)),
}
RULE_VERSION = "1.0"
CONFIDENCE_BANDS = {"high": 0.90, "medium": 0.65, "ambiguous": 0.50}
RETENTION_DAYS = {"entity_links": 365, "unmatched_entities": 90, "ambiguous_matches": 90, "run_log": 180, "link_feedback": 365}
AUDIT_RETENTION_DAYS = 7 * 365


@dataclass(frozen=True)
class AuditRules:
    """Thresholds of the audit layer."""

    completeness: float = 0.90
    amount_tolerance: float = 0.05
    date_window_days: int = 3
    sigma_global: float = 2.0
    sigma_vendor: float = 3.0
    rolling_percent: float = 20.0
    contamination: float = 0.05
    decision_below: float = -0.5
    high_amount: float = 5000.0
    tool_high_amount: float = 10000.0
    critical: int = 70
    warning: int = 50
    approve_below: float = 50.0
    gap: float = 0.15
    vendor_fp: float = 0.80
    rule_fp: float = 0.50
    whitelisted: tuple[str, ...] = ()
    domains: dict[str, tuple[int, float]] = field(default_factory=lambda: {"default": (48, 1000.0)})


AUDIT = AuditRules()


def save_rules(rules: AuditRules, path: str) -> None:
    """Write rules as JSON to a file of the driver, in place of what is there."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as file:
        json.dump(asdict(rules), file, indent=1)
    os.replace(beside, path)


def load_rules(path: str) -> AuditRules:
    """Rules that ``save_rules`` has written; the defaults if there is no such file."""
    if not os.path.exists(path):
        return AUDIT
    with open(path, encoding="utf-8") as file:
        kept = json.load(file)
    return AuditRules(**kept | {"whitelisted": tuple(kept["whitelisted"]), "domains": {k: tuple(v) for k, v in kept["domains"].items()}})

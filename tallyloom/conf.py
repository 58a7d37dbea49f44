"""Parameters of a run."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

#: Exception types, their severity, and whether they keep a group from clearing.
TAXONOMY = (
    ("AMOUNT_MISMATCH", "review", True),
    ("TIMING_LAG", "informational", False),
    ("SPLIT_PAYMENT", "review", True),
    ("MERGED_PAYMENT", "review", True),
    ("FEE_DISCREPANCY", "review", True),
    ("REFUND_OFFSET", "review", True),
    ("CHARGEBACK_DEBIT", "blocking", True),
    ("DUPLICATE_RECORD", "blocking", True),
    ("MISSING_IN_BANK", "blocking", True),
    ("MISSING_IN_GATEWAY", "review", True),
    ("MISSING_IN_LEDGER", "review", True),
    ("NARRATION_UNPARSEABLE", "review", True),
    ("UNMATCHED_RESIDUAL", "review", True),
)
SEVERITIES = ("blocking", "review", "informational")


@dataclass(frozen=True)
class Conf:
    """Defaults of a reconciliation."""

    auto_clear_threshold: float = 0.9
    amount_tolerance_paise: int = 100
    date_window_days: int = 3
    max_candidates: int = 5
    batch_limit: int = 12
    usd_inr: float = 88.0

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Conf:
        """Values of upper-case variables named as the fields; what does not parse keeps its default."""
        env = os.environ if env is None else env
        kinds: dict[str, Callable] = {"int": int, "float": float}
        found = {}
        for f in fields(cls):
            try:
                found[f.name] = kinds[str(f.type)](env[f.name.upper()])
            except (KeyError, ValueError):
                continue
        return cls(**found)

"""Governed parameters, passed to operators as literals."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Params:
    # Thresholds, caps and windows that decide results.
    strategy_version: int = 2
    selection_rule_version: int = 2
    protocol_version: int = 1
    mapping_version: str = "1"
    composite_threshold: float = 55.0
    max_candidates_per_selection: int = 5
    max_per_cohort: int = 2
    book_starting_nav: float = 100000.0
    position_notional: float = 1000.0
    max_open_positions_per_horizon: int = 100
    horizons: tuple = (20, 60)
    atr_window: int = 14
    stop_atr_multiple: float = 2.0
    target_atr_multiple: float = 4.0
    gap_cancel_atr: float = 1.0
    slippage_bps_high_liquidity: float = 5.0
    slippage_bps_mid_liquidity: float = 15.0
    adv_high_liquidity: float = 50_000_000.0
    adv_mid_liquidity: float = 5_000_000.0
    cohort_blend_target: int = 50
    cohort_blend_floor: int = 10
    dilution_disqualify: float = 22.0
    current_ratio_cap: float = 5.0
    interest_coverage_cap: float = 50.0
    high_leverage_debt_ebitda: float = 4.0
    exit_cooldown_days: int = 10
    gap_cancel_cooldown_days: int = 3
    freshness_sla: dict = field(
        default_factory=lambda: {
            "symbol_master": 168,
            "prices_daily": 72,
            "fundamentals": 720,
            "corporate_actions": 72,
            "filings": 96,
        }
    )
    universe_entry_price_min: float = 3.00
    universe_entry_market_cap_min: float = 300_000_000.0
    universe_entry_adv_min: float = 5_000_000.0
    universe_entry_xbrl_quarters_min: int = 8
    universe_retention_price_min: float = 2.50
    universe_retention_market_cap_min: float = 250_000_000.0
    universe_retention_adv_min: float = 4_000_000.0
    universe_retention_hysteresis_days: int = 20
    universe_price_data_max_gap_days: int = 5


FROZEN = Params()


def digest(params: Params = FROZEN) -> str:
    """Hash stored beside every result so a parameter change is visible."""
    text = json.dumps(asdict(params), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()

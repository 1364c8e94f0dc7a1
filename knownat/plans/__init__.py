"""Registered queries over the driver's tables."""

from . import q_facts, q_files, q_flags, q_ledger, q_populations, q_prices, q_reports, q_screened, q_states  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

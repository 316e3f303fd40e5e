"""End-to-end compositions: the batch preparation and the three reports."""

from .prepare import prepare, publish_episodes
from .reports import key_metrics, portfolio_report, risk_report, stored_system_equity, system_report

__all__ = ["key_metrics", "prepare", "publish_episodes", "portfolio_report", "risk_report", "stored_system_equity", "system_report"]

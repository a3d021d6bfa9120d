"""Registered queries: operators bound to the star-schema tables."""

from importlib import import_module

MODULES = [
    "hazard_queries", "risk_queries", "network_queries", "spatial_queries", "text_queries", "check_queries", "source_queries",
    "stream_queries", "report_queries",
]


def load_all() -> None:
    for name in MODULES:
        import_module(f"stormledger.plans.{name}")

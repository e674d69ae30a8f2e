"""Registered queries by family."""

from importlib import import_module

FAMILIES = (
    "history", "joins", "metrics", "rewrites", "profiles", "detection", "rollups", "rules",
    "governance", "protection", "retrieval", "streams", "samples", "workspace",
)


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"workloom.plans.{family}")

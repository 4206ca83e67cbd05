"""Runnable queries, one module per operator family."""

from importlib import import_module

FAMILIES = ["recode", "household", "longitudinal", "joins", "transitions", "reports", "events",
            "features", "files", "sets"]


def load_all() -> None:
    """Import every family once; importing registers its queries."""
    for family in FAMILIES:
        import_module(f"hearthpanel.plans.{family}")

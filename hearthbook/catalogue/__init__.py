"""Runnable queries over the given tables, each next to its SQL twin."""

from importlib import import_module

AREAS = ["contacts", "texts", "links", "activity", "pages", "files", "mailbox", "archives"]


def load():
    """All registered queries by name."""
    from hearthbook.catalogue.base import REGISTRY

    for area in AREAS:
        import_module(f"hearthbook.catalogue.{area}")
    return dict(REGISTRY)

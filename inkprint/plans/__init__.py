"""Registered queries by area."""

import importlib

AREAS = ("attribution", "text", "features", "models", "io")


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"inkprint.plans.{area}")

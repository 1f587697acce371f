"""Registered queries by area; ``load`` imports every area once."""

from __future__ import annotations

import importlib

from pagegrain.plans import registry

AREAS = ["urls", "texts", "pages", "structures", "grades", "journals", "benches", "searches", "graphs"]


def load():
    for area in AREAS:
        importlib.import_module(f"pagegrain.plans.{area}")
    return dict(registry.QUERIES), dict(registry.ORACLES)

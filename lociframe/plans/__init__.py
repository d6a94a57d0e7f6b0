"""Registered questions, one module per group of operators."""

from __future__ import annotations

import importlib

from lociframe.plans.registry import QUESTIONS

MODULES = ["scans", "columns", "joins", "aggregates", "readlevel", "walks", "aligned", "tracks", "calls", "streams", "files", "overlaps", "pairs", "contexts"]


def load() -> dict:
    for name in MODULES:
        importlib.import_module(f"lociframe.plans.{name}")
    return QUESTIONS

"""Registered queries by topic."""

from __future__ import annotations

import importlib

TOPICS = ["text", "quality", "words", "models", "evaluation", "log", "images"]


def _load():
    for topic in TOPICS:
        importlib.import_module(f"moodframe.plans.{topic}")
    return importlib.import_module("moodframe.plans.registry")


def all_queries() -> dict:
    return _load().QUERIES


def all_oracles() -> dict:
    return _load().ORACLES

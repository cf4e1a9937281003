"""Operators for training data and their queries. Nothing else in the library imports this."""

from __future__ import annotations


def registries():
    from careweft.llm import queries

    return [queries.REGISTRY]

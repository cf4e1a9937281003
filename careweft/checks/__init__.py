"""Queries over the given tables and the SQL that gives the same rows."""

from __future__ import annotations


def registries():
    from careweft.checks import claims, discovery, files, provider, scalars

    return [r.REGISTRY for r in (provider, claims, discovery, files, scalars)]

"""Queries over the given tables, each with the SQL that must give the same rows.

A module per area holds ``QUERIES`` (name -> function of session and folder) and ``SQL`` (name ->
text). Every query reads whole tables.
"""

from __future__ import annotations

from importlib import import_module

AREAS = ("text_rows", "targets", "samples", "scoring", "metadata", "scans", "streams", "models", "wiring")


def _merge(attribute: str) -> dict:
    out: dict = {}
    for area in AREAS:
        part = getattr(import_module(f"tabloom.registered.{area}"), attribute)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"query registered twice: {clash}")
        out.update(part)
    return out


def queries() -> dict:
    return _merge("QUERIES")


def sql() -> dict:
    return _merge("SQL")

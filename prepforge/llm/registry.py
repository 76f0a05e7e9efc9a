"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, brown, conversations, decontam, importance, metricjoin, neardup, quality, repair, substring, toxicity, urllists, wordbpe

_MODULES = (ann, brown, conversations, decontam, importance, metricjoin, neardup, quality, repair, substring, toxicity, urllists, wordbpe)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items() if s}

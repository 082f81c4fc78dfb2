"""Whole queries composed of the operators, with their SQL counterparts."""

from . import blocks, curbs, meters, places, profiling, records, rules, search, spans, staging, stored, suggest, texts
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "blocks", "curbs", "meters", "places", "profiling", "records", "rules", "search", "spans", "staging", "stored", "suggest", "texts"]

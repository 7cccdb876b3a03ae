"""Collects the queries and SQL of all plan modules."""

from __future__ import annotations

from tidemark.plans import evidence as _evidence
from tidemark.plans import flagship as _flagship
from tidemark.plans import ingest as _ingest
from tidemark.plans import portfolio as _portfolio
from tidemark.plans import relational as _relational
from tidemark.plans import series as _series
from tidemark.plans import streams as _streams

_MODULES = [_flagship, _series, _evidence, _relational, _ingest, _streams, _portfolio]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
flagship = _flagship.flagship

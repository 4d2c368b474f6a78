"""Every registered query with the SQL that states its result."""

from __future__ import annotations

from inkwell.plans import graphs, history, likeness, links, made, matching, mentions, metrics, packs, proposals, reports, review, roles, similar, standards, statements, streams, structure, summary, terms, vectors  # noqa: F401
from inkwell.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

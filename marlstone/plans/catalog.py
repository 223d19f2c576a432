"""All queries of the engine by name, with their SQL counterparts."""

from __future__ import annotations

from marlstone.plans import catalyst, cross_section, digest_runs, digests, events, feeds, folds, ledger, news, portfolio, ratings, refinement, relational, replies, screening, search, snapshots, streams, tables

FAMILIES = [catalyst, cross_section, digest_runs, digests, events, feeds, folds, news, ledger, portfolio, ratings, refinement, relational, replies, screening, search, snapshots, streams, tables]
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}

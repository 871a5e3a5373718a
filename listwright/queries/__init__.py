"""Registered queries: the jobs applied to the driver's tables."""

from listwright.queries import imports, scoring, streams, tracker

QUERIES = {**scoring.QUERIES, **imports.QUERIES, **tracker.QUERIES, **streams.QUERIES}

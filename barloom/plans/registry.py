"""All registered queries of the library proper, with their SQL."""

from __future__ import annotations

from barloom.plans import fits, ingest, market, study

flagship = market.flagship
QUERIES = {**market.QUERIES, **fits.QUERIES, **ingest.QUERIES, **study.QUERIES}
ORACLES = {**market.ORACLES, **fits.ORACLES, **ingest.ORACLES, **study.ORACLES}

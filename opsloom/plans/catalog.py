"""All registered queries."""

from __future__ import annotations

from opsloom.plans import corpus, history, mine, retrieve, session, stream

FAMILIES = [retrieve, corpus, history, mine, session, stream]

ALL = {name: pair for family in FAMILIES for name, pair in family.QUERIES.items()}
flagship = retrieve.flagship

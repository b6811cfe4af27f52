"""Named queries: operators applied to whole tables, with SQL where it can express them."""

from . import corpus, evidence, frames, jobstore, records, versions

MODULES = (jobstore, corpus, versions, evidence, records, frames)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}

"""Named queries over the test data, and the SQL that must give the same rows."""

from pricing_engine.catalogue import jobs, jobs_sql, names, names_sql, scores_sql, stored, stored_sql

QUERIES = {**stored.QUERIES, **names.QUERIES, **jobs.QUERIES}
ORACLES = {**stored_sql.ORACLES, **names_sql.ORACLES, **scores_sql.ORACLES, **jobs_sql.ORACLES}

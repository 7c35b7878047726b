"""All queries of the library with the SQL that checks them."""

from quillspark.plans import note_queries, work_queries

QUERIES = {**note_queries.QUERIES, **work_queries.QUERIES}
ORACLES = {**note_queries.ORACLES, **work_queries.ORACLES}

"""All registered queries over the driver tables and their SQL."""

from seqloom.plans import cluster_queries, file_queries, sampling_queries, scoring_queries, sequence_queries, structure_queries, training_queries

_PARTS = (sequence_queries, cluster_queries, sampling_queries, structure_queries, training_queries, scoring_queries, file_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}

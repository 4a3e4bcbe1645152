"""All queries and their SQL, from the sections."""

from workload.sections import checks, cleaning, clauses, metrics, privacy, risk, streams

SECTIONS = [streams, checks, cleaning, privacy, clauses, risk, metrics]
QUERIES = {name: query for section in SECTIONS for name, query in section.QUERIES.items()}
ORACLE = {name: sql for section in SECTIONS for name, sql in section.ORACLE.items()}

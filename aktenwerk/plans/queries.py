"""All queries of the package with their SQL."""

from aktenwerk.plans import letters, tables

QUERIES = {**letters.QUERIES, **tables.QUERIES}
SQL = {**letters.SQL, **tables.SQL}

"""Incident analytics on Spark DataFrames.

Sources produce canonical incident rows, operators de-duplicate, match, corroborate and cluster them, and
serving functions answer the read queries.  Everything is a function from DataFrame (or Column) to DataFrame
(or Column); nothing holds state outside Spark tables.
"""

__version__ = "0.1.0"

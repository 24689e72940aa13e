"""Training-data operators: ten independent operators over corpus tables.

Nothing else in the library imports this subpackage; ``catalog`` holds the
queries that ``__spark_entry__`` registers when the subpackage is present.
"""

"""Training-data pipeline operators: tokenising, sharding, cleaning, scoring, deduplication.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""

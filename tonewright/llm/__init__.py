"""Training-data operators: deduplication, filtering, tokenising, packing, mixing, archiving and sharding.

Nothing outside this folder imports it. Each operator is a module with its own general interface; queries.py
holds the thin opN_ queries over the given tables.
"""

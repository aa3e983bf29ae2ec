"""Training-data operators: tokenising, scoring, sharding, filtering, deduplication, archives, packing.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it. Each module holds one operator with a
general interface; ``queries`` registers the thin ``opN_<name>`` queries and the SQL that checks them.
"""

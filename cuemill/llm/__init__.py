"""Training-data operators: language ID, filters, deduplication, packing, chat rendering, tokenising, scoring.

Nothing outside this folder imports it.  The operators work on DataFrames and
keep a general interface; :mod:`cuemill.llm.queries` holds the thin registered
queries and their SQL.
"""

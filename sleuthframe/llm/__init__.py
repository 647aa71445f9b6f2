"""Training-data operators: dedup, filters, extraction, counting and mixing for large text corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns a DataFrame; the thin contract queries are in :mod:`.queries`.
"""

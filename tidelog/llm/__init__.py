"""Training-data operators: sharding, filters, tokenisation, dedup and archives.

Nothing outside this folder imports it, so it can be removed without
touching the event-log engine.  ``queries.py`` registers one query per
operator for ``__spark_entry__.py``.
"""

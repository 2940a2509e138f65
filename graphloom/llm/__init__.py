"""Training-data operators: scoring, matching, sharding and encoding of document tables.

Nothing outside this subpackage imports it, apart from the guarded
registration in ``__spark_entry__`` and ``corpus_pipeline``.
"""

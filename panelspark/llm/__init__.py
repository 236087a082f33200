"""Training-data operators (deduplication, decontamination, mixing, sharding, scoring).

Nothing outside this subpackage, ``corpus_pipeline.py`` and the guarded part of
``__spark_entry__.py`` imports it.
"""

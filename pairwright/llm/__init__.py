"""Training-data operators: counting, packing, cleaning, deduplicating, sharding.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""

"""Training-data operators: each module has one operator, ``queries.py`` the thin queries over them.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` depends on it.
"""

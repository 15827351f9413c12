"""Operations on training data: one module an operator, `registry` names the queries.

Nothing outside this folder (and corpus_pipeline.py) imports it."""

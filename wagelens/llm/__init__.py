"""Operators of a training-data pipeline (one module per operator).

Nothing outside this subpackage imports it.  ``registry`` lists the queries;
``corpus_pipeline.py`` at the top of the repository chains five of them.
"""

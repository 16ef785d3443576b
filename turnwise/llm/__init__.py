"""Operators for large training corpora.

Nothing else in the package imports this one.  Every operator takes and returns
DataFrames; ``registry`` lists the ``opN_*`` queries, ``corpus_pipeline`` at the
top of the repository chains five of them.
"""

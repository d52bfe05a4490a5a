"""Training-data operators: quality, deduplication, decontamination, mixing and output of text corpora.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames; the
``opN_`` queries over the ``documents``, ``pages``, ``labels`` and ``benchmark`` tables are in ``queries``.
"""

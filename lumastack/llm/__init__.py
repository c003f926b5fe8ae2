"""Operations of a training-data pipeline over documents, pages and embeddings.

Nothing else in the package imports this subpackage. Each operator module
holds one operator with a general interface; ``queries`` registers the thin
``opN_`` digests over the whole tables.
"""

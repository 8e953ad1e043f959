"""Operations of a training-data pipeline on documents, embeddings and pages.

Nothing else in the library imports this subpackage.
"""

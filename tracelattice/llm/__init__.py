"""Operations of a training-data pipeline: filters, duplicates, search, token output.

Nothing else in the library imports this subpackage.
"""

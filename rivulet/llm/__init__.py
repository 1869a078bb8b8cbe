"""Operations of a training-data pipeline: filters, deduplication, packing, formats.

Nothing else in the package imports this subpackage.
"""

"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this package; ``queries.py`` holds the
registered ``opN_<name>`` queries.
"""

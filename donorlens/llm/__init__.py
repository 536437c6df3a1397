"""Operators for preparing large text corpora (training-data pipelines).

Every module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries over the test tables.
"""

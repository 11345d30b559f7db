"""Operators for training-data pipelines over a documents table.

Nothing outside this folder imports it.  ``queries`` registers the thin
``opN_<name>`` queries; every operator module keeps a general interface.
"""

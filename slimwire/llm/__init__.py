"""Operators of a training-data pipeline: scans, scores, fingerprints, joins, mixes and extraction.

Each module holds one operator with its own general interface; ``queries`` registers one
``opN_<name>`` query per operator over its whole table. Nothing else in the library imports
this subpackage.
"""

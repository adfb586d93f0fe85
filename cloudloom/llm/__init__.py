"""Operators of a training-data pipeline over document and embedding tables.

One module for each operator; ``queries`` registers the thin query of each and
``common`` holds what they share. Nothing outside this subpackage imports it.
"""

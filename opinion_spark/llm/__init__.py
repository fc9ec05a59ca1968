"""Operators for preparing training data from large document tables.

One module per operator; ``queries`` registers them, ``sql`` holds the equivalent SQL where it
exists. Nothing outside this package and ``corpus_pipeline`` imports it.
"""

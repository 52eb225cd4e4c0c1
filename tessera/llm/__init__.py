"""Operators for preparing language-model training data.

Every module holds one operator with its own interface; ``queries`` registers
one thin query per operator, and ``corpus_pipeline.py`` at the repository top
chains five of them.  Nothing else in the library imports this package.
"""

"""Training-data operators for very large text corpora.

Every module here is independent of the rest of the package, and nothing in
the rest of the package imports this subpackage.
"""

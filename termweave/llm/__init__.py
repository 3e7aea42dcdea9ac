"""Training-data operators: one module per operator, queries in ``queries``.

Nothing else in the package imports this subpackage.
"""

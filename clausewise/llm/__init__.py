"""Training-data operators: one module per operator, plus queries and SQL.

Nothing else in the library imports this subpackage.
"""

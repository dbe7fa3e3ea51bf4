"""Operators for preparing training data, with their registered queries.

Nothing outside this package imports it; ``registry`` collects the queries and SQL texts of its modules.
"""

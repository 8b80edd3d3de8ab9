"""Operators that prepare training data at corpus scale.

Nothing else in the library imports this subpackage. Each module holds one operator with a
general interface and real outputs; ``queries`` derives from them the result rows of the
registered queries.
"""

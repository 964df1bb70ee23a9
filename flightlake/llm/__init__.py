"""Operators for preparing training data: ten corpus operators and their queries.

Nothing else in the library imports this subpackage; ``entry.py`` holds its
queries and their SQL. Executors import it too, so it has to be on their
``PYTHONPATH`` (or shipped with ``--py-files``).
"""

"""Training-data operators: ten stand-alone modules, their queries and SQL.

Nothing else in the library imports this subpackage.
"""

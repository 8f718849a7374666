"""Registered queries (``queries.py``) and their DuckDB SQL equivalents (``oracle.py``)."""

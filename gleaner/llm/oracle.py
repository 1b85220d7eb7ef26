"""DuckDB SQL for the queries that SQL can express (views named as the tables)."""

ORACLE: dict[str, str] = {}

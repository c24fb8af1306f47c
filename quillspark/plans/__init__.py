"""Queries and their SQL."""


def whole(sql: str, *columns: str) -> str:
    """``sql`` with sums that the oracle widens given back as whole numbers."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)}) FROM ({sql})"


def with_whole(sql: dict[str, str], columns: dict[str, str]) -> dict[str, str]:
    return {name: whole(s, columns[name]) if name in columns else s for name, s in sql.items()}

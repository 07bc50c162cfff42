"""Pages by key: the next page begins behind the last score and id, however deep it lies."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import InvalidQuery

START = "*"


def cursor_of(score: float, id_: object) -> str:
    return base64.urlsafe_b64encode(json.dumps([score, id_]).encode()).decode()


def read_cursor(cursor: str) -> tuple[float, object]:
    try:
        score, id_ = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        return float(score), id_
    except (ValueError, TypeError) as e:
        raise InvalidQuery(f"no cursor: {cursor[:80]!r}") from e


def behind(score: Column, id_: Column, cursor: str | None) -> Column:
    """True for rows that come after a cursor in order of score, descending, and id."""
    if cursor in (None, START):
        return F.lit(True)
    last_score, last_id = read_cursor(cursor)
    return (score < last_score) | ((score == last_score) & (id_ > F.lit(last_id)))


def page(rows: DataFrame, size: int, cursor: str | None = None) -> DataFrame:
    """The first ``size`` rows behind the cursor, best score first, then smallest id."""
    if size < 0:
        raise InvalidQuery(f"a page of {size}")
    return rows.filter(behind(F.col("score"), F.col("id"), cursor)).orderBy(F.desc("score"), F.col("id").asc()).limit(size)


def next_cursor(page_rows: list, cursor: str | None) -> str:
    """The cursor behind a page; at the end it stays as it is."""
    return cursor_of(page_rows[-1]["score"], page_rows[-1]["id"]) if page_rows else cursor or START


def pages(total: int, size: int) -> int:
    """Number of pages of ``size`` rows."""
    return -(-total // size) if size > 0 else 0

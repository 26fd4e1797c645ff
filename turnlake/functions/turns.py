"""SQL fragments and column expressions over turn rows.

Wide selects and aggregations are written as SQL text: Spark parses one string much faster
than Python builds the same tree of columns call by call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOME = """CASE WHEN move = 'C' AND opponent_move = 'C' THEN 'mutual_coop'
     WHEN move = 'D' AND opponent_move = 'D' THEN 'mutual_defect'
     WHEN move = 'C' AND opponent_move = 'D' THEN 'exploited'
     ELSE 'exploiter' END"""


def ratio(part: str, whole: str) -> str:
    """Double quotient of two exact counts or sums; NULL where there is nothing to divide by."""
    return f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"


def named(columns: dict[str, str]) -> list[Column]:
    """Columns from SQL text by name."""
    return [F.expr(f"{text} AS {name}") for name, text in columns.items()]


def surrogate_key(*columns: str) -> str:
    """md5 over the columns as text, joined by '-', with NULL spelled ``_null_``."""
    parts = [f"coalesce(CAST({name} AS STRING), '_null_')" for name in columns]
    return "md5(concat(" + ", '-', ".join(parts) + "))"


def phi(n: str, both: str, x: str, y: str) -> str:
    """Pearson correlation of two yes/no variables from their counts.

    The numerator is a difference of products of counts, exact in 38 digits (a product of
    two BIGINT counts overflows on long logs). NULL where one variable never varies.
    """

    def exact(name: str) -> str:
        return f"CAST({name} AS DECIMAL(19, 0))"

    def double(text: str) -> str:
        return f"CAST({text} AS DOUBLE)"

    products = f"{exact(n)} * {exact(both)} - {exact(x)} * {exact(y)}"
    spread = " * ".join(map(double, [x, f"{n} - {x}", y, f"{n} - {y}"]))
    return f"{double(products)} / nullif(sqrt({spread}), 0)"

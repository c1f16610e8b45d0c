"""Fragments of DuckDB SQL that the oracles share."""

from __future__ import annotations

import re


class DuckSql:
    """Spelling of times, percentiles and items."""

    def epoch(self, ts: str) -> str:
        """Whole seconds since 1970."""
        return f"CAST(floor(epoch({ts})) AS BIGINT)"

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def list_sorted(self, x: str) -> str:
        """Distinct values in order, joined by commas."""
        return f"array_to_string(list_sort(list(DISTINCT {x})), ',')"

    def item(self, x: str, i: int) -> str:
        """Array item, from 1."""
        return f"({x})[{i}]"

    def day(self, ts: str) -> str:
        return f"CAST(strftime({ts}, '%Y%m%d') AS INT)"

    def weekday(self, ts: str) -> str:
        """Monday is 0."""
        return f"CAST(isodow({ts}) - 1 AS INT)"

    def try_double(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def numbers(self, n: int) -> str:
        return f"(SELECT range AS i FROM range({n}))"


def doubled(text: str) -> str:
    """Numbers with a point as doubles, which DuckDB would read as decimals."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\g<1>e0", text)

"""Column-name rules."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame


def snake_name(header: str) -> str:
    """Lower case, '%' as 'pct', every other run of non-alphanumerics as one underscore."""
    text = header.strip().lower().replace("%", " pct ")
    return re.sub(r"[^0-9a-z]+", "_", text).strip("_")


def snake_names(headers: list[str], exceptions: Mapping[str, str] | None = None) -> list[str]:
    """Snake names in place; a repeated name gets its occurrence number (name, name_1, ...)."""
    seen: dict[str, int] = {}
    result = []
    for header in headers:
        name = snake_name(header)
        nth = seen.get(name, 0)
        seen[name] = nth + 1
        name = f"{name}_{nth}" if nth else name
        result.append((exceptions or {}).get(name, name))
    return result


def rename_to_snake(df: DataFrame, exceptions: Mapping[str, str] | None = None) -> DataFrame:
    return df.toDF(*snake_names(df.columns, exceptions))

"""CSV records that do not fit the header of their file go to a quarantine table instead of being bent to fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.sources.tables import MISSING_WORDS, found, positional_names

#: what can be wrong with a record
EMPTY, OPEN_QUOTE, TOO_FEW, TOO_MANY = "empty", "open quote", "too few cells", "too many cells"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def _well_quoted(record: Column) -> Column:
    """Whether every quote belongs to a cell that is quoted as a whole."""
    return ~F.regexp_replace(record, rf'(^|,){_QUOTED}(?=,|$)', "$1").contains('"')


def split_record(record: Column) -> Column:
    """The cells of a well-quoted record as text: without their quotes, doubled quotes once."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf',({_QUOTED}|[^",]*+)'), F.lit(1))
    return F.transform(cells, lambda c: F.when(
        c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(c))


def read_checked(
    spark: SparkSession, path: str, missing_words: Sequence[str] = MISSING_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of CSV files that each begin with the same header: every record is in exactly one of the two.

    Rows have a text column for each header cell, bound by position; cells that are one of missing_words are
    NULL. The quarantine has file, record (as it stands in the file), n_cells (NULL if it cannot be told) and
    reason. A record is a line; one whose quotes are still open at its end is quarantined (read files with line
    breaks inside cells by `read_raw(..., line_breaks=True)`). Lines equal to the header are no records. An empty
    file gives two empty tables. Both come from one narrow scan each: no shuffle, no Python.
    """
    lines = found(lambda: spark.read.text(path), path)
    first = lines.first()
    header = first["value"] if first else ""
    names = positional_names(spark.range(1).select(split_record(F.lit(header))).first()[0])
    record = F.col("record")
    parsed = lines.where(F.col("value") != header).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("record")
    ).withColumn("cells", F.when((F.trim(record) != "") & _well_quoted(record), split_record(record)))
    n_cells = F.when(F.col("cells").isNotNull(), F.size("cells"))
    reason = (
        F.when(F.trim(record) == "", EMPTY).when(F.col("cells").isNull(), OPEN_QUOTE)
        .when(n_cells < len(names), TOO_FEW).when(n_cells > len(names), TOO_MANY)
    )
    checked = parsed.select("file", "record", "cells", n_cells.alias("n_cells"), reason.alias("reason"))
    cells, words = [F.get("cells", F.lit(k)) for k in range(len(names))], list(missing_words)
    good = checked.where("reason is null").select(
        *[(F.when(~c.isin(words), c) if words else c).alias(name) for c, name in zip(cells, names)]
    )
    return good, checked.where("reason is not null").drop("cells")

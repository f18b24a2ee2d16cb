"""J8 export: CSV rows (F14) and the CSV/JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import child_paths
from ..sources import fixed

BOM = "﻿"


def csv_rows(records: DataFrame, flag: str = "is_alumni", ts: str = "publication_date",
             id_col: str = "id") -> DataFrame:
    """F14 + O2: flagged records newest first (NULL dates first, id
    tie-break), as the 17 text cells: text collapsed, date 'yyyy-MM-dd' or
    '', boolean 'true'/'false' (NULL -> 'false'), NULL coordinates ''."""
    cells = []
    for c in fixed.CSV_COLUMNS:
        if c == "id":
            cells.append(F.col(c).cast("string").alias(c))
        elif c == "publication_date":
            cells.append(F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c))
        elif c == "is_alumni":
            cells.append(F.when(F.coalesce(F.col(c), F.lit(False)), F.lit("true")).otherwise(F.lit("false")).alias(c))
        elif c in ("latitude", "longitude"):
            cells.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
        else:
            cells.append(T.csv_text(F.col(c)).alias(c))
    return (records.where(F.coalesce(F.col(flag), F.lit(False)))
                   .orderBy(F.desc_nulls_first(ts), F.asc(id_col))
                   .select(*cells))


def write_csv(rows: DataFrame, path: str, single_file: bool = True) -> None:
    """UTF-8 with BOM, header, CRLF, minimal quoting with doubled
    quotes.  ``single_file`` is for the human download only (one writer
    task); the BOM rides on the first header cell so no file is rewritten
    afterwards.  Bulk exports go through :func:`write_csv_parts`.  Exporting
    nothing is an error, as in the original download."""
    if rows.isEmpty():  # bounded check (one row at most)
        raise ValueError("No records available to export")
    out = rows.coalesce(1) if single_file else rows
    first = out.columns[0]
    if single_file:
        out = out.withColumnRenamed(first, BOM + first)
    (out.write.mode("overwrite")
        .option("header", True).option("quote", '"').option("escape", '"')
        .option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("encoding", "UTF-8")
        .csv(path))


def write_csv_parts(rows: DataFrame, path: str, order: list, manifest: str | None = None) -> list[str]:
    """S7 for large sets: the file of :func:`write_csv` in parts of a range
    each, written by many tasks.  Rows are in the order of ``order`` (columns,
    or sort expressions over fields of ``_cells``; ties stay together, so end
    it with a key), BOM and header lead the first part only, and the parts
    one after another are the file.  Returns their paths in order, and writes
    them (``position``, ``part``) to the table ``manifest``.

    Null cells are empty; a row's line breaks are quoted; no rows are an error."""
    if rows.isEmpty():  # bounded check (one row at most)
        raise ValueError("No records available to export")
    spark, quoting = rows.sparkSession, {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
                                         "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    # The cells as one struct, so that the columns of this function clash with none of theirs.
    cells = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_cells"))
    line = F.to_csv("_cells", quoting)
    titles = spark.range(1).select(F.lit(None).cast(cells.schema["_cells"].dataType).alias("_cells"), F.lit(0).alias("_rank"),
                                   F.concat(F.lit(BOM), F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]),
                                                                 quoting)).alias("_line"))
    keys = [F.col(f"_cells.`{c}`") if isinstance(c, str) else c for c in order]
    (titles.unionByName(cells.select("_cells", F.lit(1).alias("_rank"), line.alias("_line")))
           .orderBy("_rank", *keys).select("_line")
           .write.mode("overwrite").option("lineSep", "\r\n").text(path))
    parts = sorted(p for p in child_paths(spark, path) if p.rsplit("/", 1)[-1].startswith("part-"))
    if manifest:  # a row a part
        spark.createDataFrame(list(enumerate(parts)), "position int, part string").coalesce(1).write.mode("overwrite").parquet(manifest)
    return parts


def json_lines(records: DataFrame, columns=None) -> DataFrame:
    """One JSON object per record with the public columns."""
    from .serve import json_projection
    p = json_projection(records, columns)
    return p.select(F.to_json(F.struct(*p.columns)).alias("json"))

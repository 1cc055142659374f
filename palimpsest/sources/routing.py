"""Route a document path (or URL) to its reader by lower-cased suffix; unsupported -> quarantine
row with a ``reason`` instead of an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: suffix -> reader ------------------------------------------------------------
READERS = {
    ".docx": "docx",
    ".doc": "docx",
    ".txt": "txt",
    ".xlsx": "xlsx",
    ".xls": "xlsx",
}
UNSUPPORTED = "No extractor available for extension: "
# -------------------------------------------------------------------------------------------------

# path part of a URL (scheme and host removed, query and fragment cut); a plain path is taken as it is
URL_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
URL_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
NAME_RE = r"([^/]*)$"
# Python's Path.suffix: the last ".xxx" of the name, with a non-empty stem before it
SUFFIX_RE = r"^.+(\.[^.]+)$"


def suffix(path_col) -> "F.Column":
    path = F.when(path_col.rlike(URL_RE), F.regexp_extract(path_col, URL_PATH_RE, 1)).otherwise(path_col)
    name = F.regexp_extract(path, NAME_RE, 1)
    return F.lower(F.regexp_extract(name, SUFFIX_RE, 1))


def reader_for(ext) -> "F.Column":
    return F.element_at(F.create_map(*[F.lit(x) for kv in READERS.items() for x in kv]), ext)


def route_paths(df: DataFrame, path_col: str) -> DataFrame:
    ext = suffix(F.col(path_col))
    return (df.withColumn("ext", ext)
            .withColumn("reader", F.when(F.col("ext") != "", reader_for(F.col("ext"))))
            .withColumn("reason", F.when(F.col("reader").isNull(), F.concat(F.lit(UNSUPPORTED), F.col("ext")))))

"""Records of large XML files: a file is split at its record elements wherever it lies, and read by many tasks."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import escape_xml
from ..functions.typed import from_xml


def records(spark: SparkSession, path: str | list[str], row: str, schema: str | T.StructType | None = None, namespaces: Mapping[str, str] | None = None) -> DataFrame:
    """path, xml, error, and with a schema value: a row for each element named `row` in the files (UTF-8), from its start tag to its end; elements of this name do not nest.

    Spark's reader of lines does the splitting, with the start of the record's tag for a line's end: a task takes a byte range of a file, begins at its
    first record and reads the last one to its end, so a file may be of any size and in any store, and only a record is held. What stands
    before the first record of a file and after a record's end is passed over. A piece that begins as a record and does
    not end as one (cut off, or with an element inside whose name begins alike) is told in error, with a null xml. namespaces (prefix to
    name) are declared on each record, as those around it are not seen; entities of a document type are not known.
    """
    if not re.fullmatch(r"[\w.:-]+", row):
        raise ValueError(f"not a name: {row!r}")
    lines = spark.read.option("lineSep", f"<{row}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("_v"))
    # the name may go on: then it is another element, or what stands before the first record
    mine = lines.filter(F.regexp_like("_v", F.lit(r"^[\s/>]")))
    name = re.escape(row)
    tag = r"^(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>"
    head = F.regexp_extract("_v", f"({tag})", 1)
    end = F.regexp_extract("_v", rf"(</{name}\s*>)", 1)
    body = F.when(F.endswith(head, F.lit("/>")), head).when((head != "") & (end != ""), F.concat(F.substring_index("_v", f"</{row}", 1), F.lit(f"</{row}>")))
    spaces = F.concat(F.lit(""), *[F.concat(F.lit(f' xmlns:{k}="' if k else ' xmlns="'), escape_xml(F.lit(v), True), F.lit('"')) for k, v in (namespaces or {}).items()])
    xml = F.concat(F.lit(f"<{row}"), spaces, body)
    out = mine.select("path", xml.alias("xml")).withColumn("error", F.when(F.col("xml").isNull(), F.lit(f"a {row} that does not end")))
    return out if schema is None else out.withColumn("value", from_xml(F.col("xml"), schema))

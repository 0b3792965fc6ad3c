"""Where templates come from: texts that are given, a folder that Spark reads, and those that come with the library."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from importlib import resources
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Ends that are tried after a name, in this order.
ENDS = ("", ".xhtml", ".html", ".xml")
#: Files that a folder of templates may have: they are held by the driver, as templates are compiled there.
MOST_FILES = 10_000


def built_in() -> dict[str, str]:
    """The library's own templates by name."""
    return {x.name: x.read_text() for x in resources.files("treeloom.resources").iterdir() if x.name.endswith(ENDS[1:])}


def folder(spark: SparkSession, path: str) -> dict[str, str]:
    """The texts of all files below a folder in any store, by their path inside it."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value").limit(MOST_FILES + 1).collect()
    if len(rows) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} templates in {path}")
    top = "/" + path.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    return {unquote(r.p).split(top, 1)[-1]: r.value for r in rows}


class Templates(Mapping):
    """Templates by name, from several sources: the first that has the name, or the name with one of ENDS, counts; the library's own come last."""

    def __init__(self, *sources: Mapping[str, str]) -> None:
        self.sources = [*sources, built_in()]

    def __getitem__(self, name: str) -> str:
        for source in self.sources:
            for end in ENDS:
                if name + end in source:
                    return source[name + end]
        raise KeyError(name)

    def __iter__(self) -> Iterator[str]:
        return iter(dict.fromkeys(n for s in self.sources for n in s))

    def __len__(self) -> int:
        return len(list(iter(self)))

"""What several operators share: words, fingerprints, names; scratch tables are the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir  # noqa: F401  the operators take them from here

#: ASCII white space: the only characters that end a word or are stripped from a line.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are. Texts of ASCII alone take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit fingerprints with different seeds; equal pairs are taken as equal values."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5DEECE66D), *cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken, *names: str) -> tuple[str, ...]:
    """The names, with underscores behind those that a table has already (in any case): for working columns that must not clash with a caller's."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return tuple(out)


def power_of_two(n: float) -> int:
    return 1 << max(0, int(n - 1).bit_length()) if n > 1 else 1

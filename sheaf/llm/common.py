"""Pieces shared by the corpus operators.

Conventions that hold for every operator here:

* ``text`` null is the empty text; ``doc_id`` null is a document of its own id
  that sorts after every other id;
* operators select the columns they need first, so further columns of the input
  can have any name;
* equal rows are separate rows unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import released, settled

#: Bytes that count as white space in every word pattern here: space, \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A null id sorts last.
LAST_ID = 9223372036854775807
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

__all__ = ["released", "settled"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once a row even if the body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.lit(11), whole(text))


def id_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle with a table that grows with the input too, never by broadcast.

    Spark takes the size of a table from its compressed files and doesn't count the rows
    that ``explode`` makes of one. By its default threshold it would gather many times
    as many bytes on the driver as it allows, which runs out of memory there.
    """
    return df.hint("merge")


def documents_again(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, ``n_chars`` counted anew."""
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))

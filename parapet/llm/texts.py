"""Word and white-space rules that several operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet.storage import written

#: ASCII white space, the only characters that separate words
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z on UTF-8 bytes
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def spaced(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text, A-Z lower-cased (``bytes.split`` cuts at ASCII white space only)."""
    return [] if text is None else text.encode().translate(LOWER).split()


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(docs):
    """The frame with ``_file`` and ``_row``, which name a row also where ids are null or repeat.

    A frame that is not a plain scan is written to the shared folder first.
    """
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        return docs.select("*", *at)
    except AnalysisException:
        return written(docs, "placed").select("*", *at)


def apart(docs, *names: str):
    """The frame under plain column names that clash with nothing, and the new names of ``names``."""
    here = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*here), *(here[docs.columns.index(n)] for n in names)


def cuts(data: bytes, size: int, borders: tuple[bytes, ...] = (b"\n", b" ")):
    """Parts (from, to) of about ``size`` bytes that end at one of the borders, so that no word is cut."""
    lo = 0
    while lo < len(data):
        hi = len(data)
        if hi - lo > size:
            hi = min((at for at in (data.find(b, lo + size) for b in borders) if at >= 0), default=hi)
        yield lo, hi
        lo = hi

"""Known licences by a canonical digest of the entire text.

Canonical: lower case; lines that begin with a copyright mark left out; every run of
characters that are neither letters nor digits is one space; equivalent spellings
made one. The SHA-256 of that is joined with the digests of known licences. A whole
document is one text, and so is each of its lines, for notices that stand on a line
of their own.

Null and empty texts, and texts of copyright lines only, match nothing; lines without a
letter or digit are left out before the join. Rows that repeat a ``doc_id`` are scanned
each. The table of licences is broadcast up to
``BROADCAST_LICENCES`` rows, which bounds it, and shuffled beyond. Only the two
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import KNOWN

BROADCAST_LICENCES = 50_000
COPYRIGHT = r"^[ \t\r]*(copyright|\(c\)|©)"
NOT_A_WORD = r"[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]"
#: Spellings that mean the same, after punctuation is gone.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("whilst", "while"),
    ("organisation", "organization"), ("merchantibility", "merchantability"), ("http ", "https "),
)


def canonical(text: Column) -> Column:
    lines = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\n"), lambda x: ~x.rlike(COPYRIGHT))
    out = F.trim(F.regexp_replace(F.array_join(lines, " "), NOT_A_WORD, " "))
    for found, put in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def known(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """``licence, text``: the texts of ``licence_texts``, and the files of a folder under their names.

    A folder of published texts (a distribution's, or one kept for the purpose) widens
    what is found; it lies in any store that Spark reads.
    """
    own = spark.createDataFrame([(name, text) for name, text in KNOWN], "licence string, text string")
    if folder is None:
        return own
    files = spark.read.text(folder, wholetext=True)
    path = files.metadataColumn("_metadata")["file_name"]
    return own.unionByName(files.select(F.regexp_replace(path, r"\.(txt|md)$", "").alias("licence"), F.col("value").alias("text")))


def digests(licences: DataFrame) -> DataFrame:
    """``digest, licence``; of licences with the same canonical text, the first name."""
    rows = licences.select("licence", canonical(F.col("text")).alias("text")).where("text <> ''")
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, licence, n_notices, notices`` for every row: the licence that is the whole text, and those on lines."""
    table = digests(licences)
    if table.count() <= BROADCAST_LICENCES:
        table = F.broadcast(table)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    units = rows.select("uid", "doc_id", F.explode(F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))),
        F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))),
    )).alias("u"))
    hits = units.select("uid", "doc_id", "u.whole", F.sha2(canonical(F.col("u.unit")), 256).alias("digest")).join(table, "digest", "left")
    line = ~F.col("whole")
    return hits.groupBy("uid", "doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.count(F.when(line, F.col("licence"))).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("licence")))), ",").alias("notices"),
    ).drop("uid")

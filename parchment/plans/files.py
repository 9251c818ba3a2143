"""The files of the supplied tables as data: sizes and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.pieces import file_pieces
from .registry import query


@query()
def s8_file_pieces(spark, sf_dir):
    """Each MiB of each table's files with its MD5 (no SQL: the files are not views)."""
    return file_pieces(spark, sf_dir)


@query()
def s9_file_digests(spark, sf_dir):
    """Size, MD5 and SHA-256 of each file, and whether its pieces, read apart, have its size (S7)."""
    whole = file_pieces(spark, sf_dir, "files")
    read = file_pieces(spark, sf_dir).groupBy("name").agg(F.sum("size").alias("read"), F.count(F.lit(1)).alias("n"))
    return whole.join(read, "name", "left").select("name", "size", "pieces", "md5", "sha256", ((F.col("size") == F.col("read")) & (F.col("pieces") == F.col("n"))).alias("complete"))

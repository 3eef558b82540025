"""Corpus preparation in five stages: quality, exact copies, near copies, personal data, packing.

Each stage works on all rows that the one before kept; between stages rows are written as Parquet.
The last stage returns the placement of each document's pieces in the packed bins.

Results that hold for every stage: an empty table gives an empty one; all columns of the input come
back, whatever their names (the last stage returns placements instead); a row is judged by its own
text and id, so rows with one id and different texts may have different fates. What a stage does with
nulls, empty and very long texts, ties and repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.best_fit_packing import best_fit_packing
from meridian.llm.common import cut, cuts, discard, table
from meridian.llm.exact_dedup import exact_dedup
from meridian.llm.jaccard_join import jaccard_members
from meridian.llm.line_crf import crf_filter
from meridian.llm.pii import personal_data, redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model accepts.

    Null, empty and blank texts go (no line is good); a null id, a repeated row or a very long text
    is judged like any other; the rows keep their columns.
    """
    return crf_filter(docs, table(spark, sf_dir, "labels"))


def without(docs: DataFrame, mark: Column, fates: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``fates`` (doc_id, mark, gone, n) names as gone; of n > 1 rows with a mark that stays, one.

    Rows are recognised by their id and ``mark``, an expression over their text. The joins are by
    shuffle at every size: how many rows go grows with the input.
    """
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("fate_id", "fate_mark"):
        while name in taken:
            name = f"_{name}"
        names.append(name)
    fates = cut(fates.where("gone or n > 1"))
    pick = lambda rows: rows.select(F.col("doc_id").alias(names[0]), F.col("mark").alias(names[1])).hint("merge")
    same = lambda rows: docs["doc_id"].cast("long").eqNullSafe(rows[names[0]]) & mark.eqNullSafe(rows[names[1]])
    gone, again = pick(fates.where("gone")), pick(fates.where("not gone"))
    if again.isEmpty():
        return docs.join(gone, same(gone), "left_anti")
    every = pick(fates)
    repeated = docs.join(again, same(again), "left_semi").withColumn(names[1], mark).dropDuplicates(["doc_id", names[1]]).drop(names[1])
    return docs.join(every, same(every), "left_anti").unionByName(repeated)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id; of repeated rows with that id, one.

    Null counts as the empty text, and a null id as smaller than all others; so of rows that hold no
    text at all one stays. Very long texts are compared by their SHA-256 and byte by byte.
    """
    found = exact_dedup(docs, keep="largest")
    fates = found.groupBy("doc_id", F.col("text_sha256").alias("mark")).agg((~F.max("kept")).alias("gone"), F.count("*").alias("n"))
    return without(docs, F.sha2(F.coalesce(docs["text"], F.lit("")), 256), fates)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (word 5-grams, Jaccard similarity 0.8 or more), the row with the smallest id, or one of them.

    Texts without words (null, empty, blank) are near nothing and all stay. A null id comes after all
    others: such a row goes if its group has another, and of a group of null ids one row stays (ties
    by the hash of the text).
    """
    members = jaccard_members(docs).where("component is not null").groupBy("component", "doc_id", F.col("text_hash").alias("mark")).agg(F.count("*").alias("n"))
    members = cut(members)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    first = members.groupBy("component").agg(F.min(order).alias("best")).withColumnRenamed("component", "group")
    fates = members.join(first, F.col("component") == F.col("group")).select("doc_id", "mark", (~order.eqNullSafe(F.col("best"))).alias("gone"), "n")
    return without(docs, F.xxhash64(docs["text"]), fates)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind; n_chars follows.

    Every row stays, repeated ones and those with a null id too; null and empty texts, and texts
    without personal data, come back unchanged.
    """
    # named first: inside select() a second use of "text" could mean the new column of that name
    found = personal_data(docs).withColumn("_clean", redacted(F.col("text"), F.col("spans"))).drop("text", "doc_id")
    row = F.col("row")
    new = {"text": F.when(row.getField("text").isNotNull(), F.col("_clean")), "n_chars": F.when(F.size("spans") > 0, F.length("_clean").cast("long")).otherwise(row.getField("n_chars"))}
    return found.select(*(new.get(c, row.getField(c)).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces' places: doc_id, piece, start, n_tokens, bin_id, bin_offset.

    Texts without words have one row without a bin; very long texts have a row for each piece; rows
    with a null id and repeated rows are placed like any other, repeated ones in different bins.
    """
    return best_fit_packing(docs)


STAGES = [("quality", quality), ("exact copies", exact_copies), ("near copies", near_copies), ("personal data", personal), ("packing", packing)]

#: SQL can't express the first, fourth and last stage; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; a stage's tables in the shared folder go when its result is written, and the result when the next one is."""
    docs, old = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        with cuts() as own:
            docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            with cuts() as result:
                docs = cut(docs)
            discard(spark, own + old)
            old = result
    return docs

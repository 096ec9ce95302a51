"""How often every distinct term occurs, and in how many records (problem 5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.plans.stage import materialize

#: White space between terms, as a Java pattern: ASCII and Unicode spaces, controls that separate, next line.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def terms_of(text: Column) -> Column:
    """Upper-case runs of characters other than white space, sorted; empty for null or blank text."""
    return F.array_sort(F.filter(F.split(F.upper(F.coalesce(text, F.lit(""))), SPACE), lambda t: t != ""))


def term_counts(fields: Sequence[tuple[str, DataFrame, str]], rare: int = 2, common: float = 0.2) -> DataFrame:
    """field, term, occurrences, records, is_rare, is_common for each (name, table, column).

    A record is a row as delivered. The terms of a record are sorted, so its
    counts are the lengths of runs: no grouping by record. Counts are combined
    by the partial hash aggregate before the shuffle, so a term in a third of
    all rows costs one row a partition. A term
    is rare if at most ``rare`` records hold it, common if at least the share
    ``common`` of the field's records that have terms do; it can be both in a
    small field.
    """
    rows = None
    for name, df, column in fields:
        one = df.select(F.lit(name).alias("field"), terms_of(F.col(column)).alias("t")).where(F.size("t") > 0)
        rows = one if rows is None else rows.unionByName(one)
    # a record's terms and counts: where each run of equal terms starts, and how far the next one is
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    rows = rows.select("field", "t", starts.alias("s"))
    each = F.transform("s", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("s", k + 1), F.size("t")) - i).cast("bigint").alias("n")))
    # one marker a record, a null term, carries the number of records that have terms
    marker = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n")))
    flat = rows.select("field", F.explode(F.concat(marker, each)).alias("e")).select("field", "e.term", "e.n")
    # written, as both the terms and the markers' totals are read from it: the input is scanned once
    counts = materialize(flat.groupBy("field", "term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records")), "terms")
    # as many rows as fields
    total = F.broadcast(counts.where(F.col("term").isNull()).select("field", F.col("records").alias("of")))
    out = counts.where(F.col("term").isNotNull()).join(total, "field")
    return out.select("field", "term", "occurrences", "records", (F.col("records") <= rare).alias("is_rare"), (F.col("records") >= F.lit(common) * F.col("of")).alias("is_common"))


def _fields(data: DataFrame, edits: DataFrame) -> list[tuple[str, DataFrame, str]]:
    return [("seg_class", data, "seg_class"), ("to_class", edits, "to_class"), ("from_class", edits, "from_class")]


def p5_terms(data: DataFrame, edits: DataFrame) -> DataFrame:
    """All terms of the three class columns with both counts and both marks."""
    return term_counts(_fields(data, edits))


def p5_found(data: DataFrame, edits: DataFrame) -> DataFrame:
    """field, term, mark: the rare and the common terms; two rows where a term is both."""
    t = term_counts(_fields(data, edits))
    marks = F.filter(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))), lambda m: m.isNotNull())
    return t.select("field", "term", F.explode(marks).alias("mark"))

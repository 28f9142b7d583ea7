"""Lines that several documents share are kept in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passel.llm.tables import ROW, held, let, of_row, released

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    """What two lines must have in common to be the same: all but blanks at the ends and the case of A to Z."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the positions in the sorted array ``dropped``, put together from the runs between them."""

    def run(end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(dropped, k - 1) + 1)
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.concat(dropped, F.array(F.size(lines))), run))


def _key_hash(line: Column, min_chars: int) -> Column:
    """128 bits of a line's key, null where it is too short."""
    return F.when(F.length(F.btrim(line, F.lit(BLANKS))) >= min_chars, F.unhex(F.md5(line_key(line))))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """All rows and columns of ``docs`` with the text cleared of repeated lines, ``n_lines`` and ``n_dropped``.

    A line whose key has ``min_chars`` code points and stands in ``min_docs`` documents stays in the
    document of the smallest id (there as often as it occurs) and goes from all others.

    Null and empty texts are one empty line and become empty texts. Rows without an id neither lose
    lines nor count as documents. Rows with the same id are one document. Input columns called like
    the new ones are replaced.

    Occurrences are counted by (line, document) first, so that a line of every third document is
    spread; the join with the repeated lines is one that adaptive execution splits.
    """
    text = F.coalesce(of_row(text_col), F.lit(""))
    # Rows that share an id are told apart by their text.
    rows = held(docs).select(ROW, of_row(id_col).alias("id"), F.xxhash64(text).alias("version"))
    # Another spelling of the key: the join then shuffles both sides, which lets a frequent line be split.
    same = F.substring("key", 1, 16)
    keys = F.transform(F.split(text, "\n", -1), lambda line: _key_hash(line, min_chars))
    held_by = (
        rows.where("id is not null")
        .select("id", "version", F.posexplode(keys).alias("pos", "key"))
        .where("key is not null")
        .groupBy("key", "id", "version")
        .agg(F.collect_set("pos").alias("at"))
        # The join below asks for this of one branch; asked of both, they keep one shuffle.
        .where(same.isNotNull())
    )
    # The sum keeps the positions in this branch too, so both use one shuffle of the lines.
    n_docs = F.when(F.min("id") != F.max("id"), F.lit(2)).otherwise(1) if min_docs == 2 else F.count_distinct("id")
    repeated = (
        held_by.groupBy("key")
        .agg(n_docs.alias("docs"), F.min("id").alias("keeper"), F.sum(F.size("at")).alias("lines"))
        .where((F.col("docs") >= min_docs) & (F.col("lines") > 1))
        .select(same.alias("same"), "keeper")
    )
    dropped = (
        held_by.join(repeated, same == F.col("same"))
        .where("id <> keeper")
        .groupBy("id", "version")
        .agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("dropped"))
    )
    joined = rows.join(dropped, ["id", "version"], "left")
    kept = let(F.split(text, "\n", -1), lambda lines: F.array_join(_without(lines, F.col("dropped")), "\n"))
    return released(
        joined,
        docs.columns,
        **{
            text_col: F.when(F.col("dropped").isNull(), text).otherwise(kept),
            "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long"),
            "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long"),
        },
    )

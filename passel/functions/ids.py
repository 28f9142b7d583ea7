"""Identifiers, hash buckets and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a passage identifier is spelled and which run sizes exist.
CHUNK_MARK = "::c"
ROW_MARK = "::row"
NO_CHUNK = -1
RUN_SIZES = {"10k": 10000, "30k": 30000, "50k": 50000}
RUN_SUFFIX = "_bench_summary.json"
FINGERPRINT_CHARS = 12


def tolerant_chunk_id(value: Column, text: bool = False) -> Column:
    """An integer chunk number, or null when it is missing, NaN or not a number.

    Numbers are cut to whole ones; a text must spell a whole number.
    """
    if text:
        whole = F.regexp_extract(value, r"(?U)^[\s\x1c-\x1f]*([+-]?\d+)[\s\x1c-\x1f]*\z", 1)
        return F.nullif(whole, F.lit("")).try_cast("int")
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number.try_cast("int"))


def build_uid(doc_id: Column, chunk_id: Column) -> Column:
    """``<id>::c<chunk>``, with -1 for a missing chunk."""
    return F.concat(
        F.coalesce(doc_id.cast("string"), F.lit("")),
        F.lit(CHUNK_MARK),
        F.coalesce(chunk_id.cast("string"), F.lit(str(NO_CHUNK))),
    )


def row_uid(doc_id: Column, row_index: Column) -> Column:
    """``<id>::row<i>``, for tables without chunk numbers."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(ROW_MARK), row_index.cast("string"))


def split_uid(uid: Column) -> Column:
    """The struct ``(id, chunk_id)`` of an identifier, split at its first mark."""
    at_chunk = F.instr(uid, CHUNK_MARK)
    at_row = F.instr(uid, ROW_MARK)
    mark = F.when(at_chunk > 0, at_chunk).when(at_row > 0, at_row)
    tail = F.trim(F.substr(uid, at_chunk + len(CHUNK_MARK)))
    whole = F.regexp_extract(tail, r"^([+-]?\d+)$", 1)
    return F.struct(
        F.when(mark.isNull(), uid).otherwise(F.substr(uid, F.lit(1), mark - 1)).alias("id"),
        F.when(at_chunk > 0, whole.try_cast("int")).alias("chunk_id"),
    )


def stable_id(*parts: Column) -> Column:
    """A content-derived identifier, the same on every run and task retry."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def hash_bucket(value: Column, buckets: int) -> Column:
    """The first eight hex digits of the SHA-1 of the text form, modulo ``buckets``."""
    digits = F.substring(F.sha1(value.cast("string")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def fingerprint(fields: dict[str, Column]) -> Column:
    """A short digest of named plain values, written as JSON with sorted names.

    The text has a space after every colon and comma, so digests agree with records made elsewhere
    in that common layout.
    """

    def entry(name: str) -> Column:
        value = F.to_json(F.struct(fields[name].alias("v")), {"ignoreNullFields": "false"})
        return F.concat(F.lit(f'"{name}": '), F.regexp_extract(value, r'(?s)^\{"v":(.*)\}$', 1))

    record = F.concat(F.lit("{"), F.concat_ws(", ", *[entry(n) for n in sorted(fields)]), F.lit("}"))
    return F.substring(F.sha1(record), 1, FINGERPRINT_CHARS)


def parse_run_name(file_name: Column, sizes: dict[str, int] = RUN_SIZES) -> Column:
    """The struct ``(domain, backend, size_label, size, size_k)`` of a run file name.

    The name reads ``<domain>_<backend words>_<size>...``; the word ``llm`` is no part of the
    backend. Without a known size all but the domain is null, so a job can route such names away.
    """
    stem = F.replace(F.substring_index(file_name, "/", -1), F.lit(RUN_SUFFIX), F.lit(""))
    domain = F.substring_index(stem, "_", 1)
    # The shortest middle part before a whole word that is a size.
    layout = rf"^[^_]*(?:_(.*?))?_({'|'.join(sizes)})(?:_.*)?$"
    found = F.nullif(F.regexp_extract(stem, layout, 2), F.lit(""))
    label = F.when(domain.isin(*sizes), domain).otherwise(found)
    middle = F.when(domain.isin(*sizes), "").otherwise(F.regexp_extract(stem, layout, 1))
    backend = F.regexp_replace(F.concat(F.lit("_"), middle), "_llm(?=_|$)", "")
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), label)
    return F.struct(
        domain.alias("domain"),
        F.when(label.isNotNull(), F.substring(backend, 2, 1 << 30)).alias("backend"),
        label.alias("size_label"),
        size.alias("size"),
        F.floor(size / 1000).cast("int").alias("size_k"),
    )

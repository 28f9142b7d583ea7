"""Merkle manifests beside plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from passel.llm.merkle import merkle_manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf int, node string, path string, tree string, n int, rank int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    i, source, lang, n, text = row
    return h(*map(enc, (i, source, lang, None if n is None else n + more, text)))


def climbed(nodes, fan):
    """The root of a list of nodes and, for each, the pairs (left, right) on its way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            first = place // fan * fan
            paths[k].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + fan])))
            at[k] = place // fan
        nodes = [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def manifest_by_hand(rows, tampered, fan):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    parts = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        parts[name] = climbed([leaf_of(r) for r in trees[name]], fan)
    root, above = climbed([parts[name][0] for name in names], fan)
    out = []
    for name, top in zip(names, above):
        for row, path in zip(trees[name], parts[name][1]):
            done = leaf_of(row, 1) if tampered(row[0]) else leaf_of(row)
            for left, right in path + top:
                done = h(left, done, right)
            proof = h(*[left + right for left, right in path + top])
            out.append((row[0], leaf_of(row), parts[name][0], root, proof, done, done == root))
    return sorted(out, key=repr)


def found(spark, rows, fan, levels):
    docs = spark.createDataFrame([(*r, 1, "x", "y", "z", 2, 3) for r in rows], DOCS).repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    frame = merkle_manifest(docs, tampered=tampered, tampered_fields={"n_chars": more}, fan=fan, levels=levels)
    return sorted((tuple(r) for r in frame.drop("path").collect()), key=repr)


def seventh(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 0


def rows_of(n, langs):
    return [(i, f"s{i % 3}", langs[i % len(langs)], None if i % 11 == 0 else i, None if i % 13 == 0 else f"téxt {i % 50}") for i in range(n)]


@pytest.mark.parametrize(("fan", "levels"), [(2, 1), (2, 3), (2, 7), (3, 2), (5, 1)])
def test_equals_plain_tree(spark, fan, levels):
    # One tree holds most rows; the others have one leaf, two, and a power of the fan.
    rows = rows_of(150, [None]) + [(1000 + i, "s", lang, 1, "x") for lang, k in (("a", 1), ("b", 2), ("é", 9), ("z", 16)) for i in range(k)]
    assert found(spark, rows, fan, levels) == manifest_by_hand(rows, seventh, fan)


def test_repeated_rows_and_ids(spark):
    rows = rows_of(20, ["en", "de"]) + [(5, "s", "en", 1, "x")] * 40 + [(None, None, None, None, None)] * 3 + [(5, "s", "en", 2, "y"), (None, "s", "en", 3, "z")]
    assert found(spark, rows, 2, 2) == manifest_by_hand(rows, seventh, 2)


def test_one_row_empty_table_and_the_largest_number(spark):
    for rows in ([(7, "s", "en", 3, "x")], [(i, "s", "en", (1 << 63) - 1, "x" * 300_000) for i in range(30)]):
        assert found(spark, rows, 2, 3) == manifest_by_hand(rows, seventh, 2)
    assert found(spark, [], 2, 3) == []


def test_proofs_unfold_without_joins(spark):
    """One shuffle and one sort for all levels of a block; what unfolds it is narrow."""
    from passel.llm.merkle import _blocks, _unfolded

    nodes = spark.range(500).selectExpr("id div 1000 AS tree", "500 + id div 1000 AS n", "id AS rank", "named_struct('h', string(id)) AS node")
    blocks = _blocks(nodes, 0, 2, 4)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and "SortAggregate" in plan
    empty = F.array().cast("array<struct<left:string,right:string>>")
    plan = _unfolded(blocks.withColumn("path", empty), 0, 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1

"""Line dedup, SimHash groups and suffix dedup beside plain Python."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connect, differences
from passel.llm import components
from passel.llm.components import connected_components
from passel.llm.line_dedup import drop_repeated_lines
from passel.llm.registered import ORACLE, QUERIES
from passel.llm.simhash import drop_near_duplicates, fingerprint, simhash_groups
from passel.llm.suffix_dedup import drop_repeated_strings, multikey_order

DOCS = "doc_id long, text string, lang string, n_lines long, id string"


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, None, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_its_sql(spark, tables, name):
    assert differences(spark, connect(tables), QUERIES[name], ORACLE[name], tables) == []


# ---- line dedup


def lines_by_hand(rows):
    """rows: (id, text); equal ids are one document."""
    keys = {}

    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 10:
                    keys.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(ids := keys.get(key(x), {i})) < 2 or min(ids) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_of_edge_texts(spark):
    texts = ["", None, "\n", "A repeated line\nown line of one\nA repeated line", "  a REPEATED line\t\nshort\n\n", "short\nshort"]
    texts += ["É repeated line", "é repeated line", "a repeated line\x0b\nb\r\nb", "\n".join(["a repeated line", "unique %s" * 3] * 2000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a repeated line"), (3, "own line of one\nother text"), (4, texts[4])]
    docs = spark.createDataFrame([(i, t, None, 7, "x") for i, t in rows], DOCS)
    got = drop_repeated_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_dropped"}
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr)
    assert found == lines_by_hand(rows)


def test_lines_with_higher_threshold(spark):
    docs = docs_of(spark, ["a line of three docs\na line of two docs"] * 2 + ["a line of three docs"])
    got = {r.doc_id: r.text for r in drop_repeated_lines(docs, min_docs=3).collect()}
    assert got == {0: "a line of three docs\na line of two docs", 1: "a line of two docs", 2: ""}


def test_lines_of_no_documents(spark):
    assert drop_repeated_lines(docs_of(spark, [])).count() == 0


def test_lines_by_chance(spark):
    chance = random.Random(4)
    pool = [f"{'Line' if i % 2 else 'line'} number {i // 2}" for i in range(30)] + ["", "x"]
    rows = [(i, "\n".join(chance.choice(pool) for _ in range(chance.randrange(8)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in drop_repeated_lines(docs).collect()), key=repr)
    assert found == lines_by_hand(rows)


# ---- SimHash


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", ["", " \n", "one", "One two", "a b c", "A b c d", "É é \x0b x y z", "w " * 70000])
def test_fingerprint(text):
    assert fingerprint(text) == fingerprint_by_hand(text)


@pytest.mark.parametrize("slice_bytes", [1, 7, 30])
def test_fingerprint_of_slices(monkeypatch, slice_bytes):
    """A long text is read in slices; shingles across their ends are not lost."""
    monkeypatch.setattr("passel.llm.simhash.SLICE", slice_bytes)
    chance = random.Random(slice_bytes)
    for n in [0, 1, 2, 3, 4, 5, 50]:
        text = " ".join(chance.choice(["a", "bb", "Ccc", "ü" * 9, ""]) for _ in range(n)) + " " * (n % 3)
        assert fingerprint(text) == fingerprint_by_hand(text), text


def test_groups_equal_all_pairs(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    own = {r.doc_id: fingerprint_by_hand(r.text) for r in docs.collect()}
    ids = sorted(own)
    codes = np.array([own[i] for i in ids], np.uint64)
    linked = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 2)]
    want = components_by_hand(ids, linked)
    rows = QUERIES["op3_simhash"](spark, tables).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{own[i]:016x}", want[i]) for i in ids}
    assert len(rows) == len(ids) and any(want[i] != i for i in ids)
    kept = [r.doc_id for r in drop_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_groups_of_edge_texts(spark):
    rows = [(5, None), (4, ""), (9, "  "), (2, "same text here now"), (7, "Same TEXT here\nnow"), (None, "same text here now"), (2, "same text here now")]
    docs = spark.createDataFrame([(i, t, None, 7, "x") for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in simhash_groups(docs).collect()), key=repr)
    assert got == sorted([(5, 4), (4, 4), (9, 4), (2, 2), (7, 2), (None, None), (2, 2)], key=repr)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([4, 2, 2, None], key=repr)
    assert simhash_groups(docs_of(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    chance = random.Random(8)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    loose = [(2000 + chance.randrange(300), 2000 + chance.randrange(300)) for _ in range(200)]
    links = chain + star + loose + [(5, 5), (3, 2)]
    want = components_by_hand({x for p in links for x in p}, links)
    chance.shuffle(links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    # A node that is linked with itself only is in no pair.
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in want.keys() - got.keys())


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    def no_round(links):
        raise AssertionError("a round")

    monkeypatch.setattr(components, "_large_star", no_round)
    links = [(2, 1), (1, 3), (4, 1), (4, 1), (9, 8), (7, 7), (None, 6)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_components_are_widened_by_more_links(spark):
    chance = random.Random(5)
    for n in (0, 25, 60):
        links = [(chance.randrange(100), chance.randrange(100)) for _ in range(40)]
        more = [(chance.randrange(130), chance.randrange(130)) for _ in range(n)]
        first, second = (spark.createDataFrame(x, "u long, v long") for x in (links, more))
        got = [tuple(r) for r in components.widened(connected_components(first), second).collect()]
        pairs = [p for p in links + more if p[0] != p[1]]
        want = components_by_hand({x for p in pairs for x in p}, pairs)
        assert sorted(got) == sorted(want.items())


# ---- suffix dedup


def strings_by_hand(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        steps = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[doc] = (len(data), int(gone.sum()), int((steps == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def digests(found):
    rows = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()
    return {r.doc_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("records", [1 << 18, 60])
def test_strings_by_chance(spark, monkeypatch, records):
    """Few records in a range force runs across ranges, whose windows are then compared one by one."""
    monkeypatch.setattr("passel.llm.suffix_dedup.RANGE_RECORDS", records)
    chance = random.Random(records)
    passages = ["".join(chance.choice("abcdé ") for _ in range(chance.randrange(60, 400))) for _ in range(10)]
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 1000), (5, "ab" * 9000)]
    for i in range(120):
        parts = [chance.choice(passages) if chance.random() < 0.6 else "".join(chance.choice("abcd ") for _ in range(chance.randrange(150))) for _ in range(5)]
        rows.append((10 + i, "".join(parts)))
    rows += [(500 + i, rows[12][1]) for i in range(30)] + [(900, "".join(passages) * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert digests(drop_repeated_strings(docs)) == strings_by_hand(rows)


def test_strings_of_real_texts(spark, tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_suffix_dedup"](spark, tables).collect()}
    assert got == strings_by_hand(rows)


def test_strings_of_edge_rows(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(80))
    rows = [(3, text), (3, text), (5, text + "é"), (None, text), (7, "one text"), (7, text), (8, None)]
    docs = spark.createDataFrame([(i, t, None, 7, "x") for i, t in rows], DOCS)
    found = drop_repeated_strings(docs)
    assert found.columns == [*docs.columns, "kept", "n_bytes", "n_removed", "n_spans"]
    got = sorted(((r.doc_id, r.n_removed, r.text) for r in found.collect()), key=repr)
    # Of the two texts of 7 one is the document, and the other stays whole.
    seven = [g for g in got if g[0] == 7]
    assert [g for g in got if g[0] != 7] == sorted([(3, 0, text), (3, 0, text), (5, len(text), "é"), (None, 0, text), (8, 0, "")], key=repr)
    assert (7, 0, "one text") in seven and len(seven) == 2
    assert drop_repeated_strings(docs_of(spark, [])).count() == 0


def test_multikey_order():
    chance = random.Random(2)
    words = ["".join(chance.choice("ab") for _ in range(6)) for _ in range(500)]
    order, run = multikey_order(len(words), lambda n, rows: np.array([ord(words[r][n]) for r in rows]), 6)
    assert order.tolist() == sorted(range(500), key=lambda i: (words[i], i))
    assert len(set(run.tolist())) == len(set(words))

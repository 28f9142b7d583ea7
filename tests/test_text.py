import html
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passel.functions import text
from passel.functions.encode import hashing_encoder, model_encoder
from passel.operators.chunk import chunk_documents
from passel.operators.documents import clean_documents

EDGE_TEXTS = [
    None,
    "",
    "   ",
    " \t\n ",
    "a b c",
    "a\x1cb\x1d c",
    "x [12] y [1, 2] z [edit]w [Edit] [] [ 3 ]",
    "[١٢] digits of another script",
    "&lt;b&gt;bold&lt;/b&gt; &amp;copy; &copy; &#233; &#xe9; &notit; &amp",
    "see http://a.b/c?d=e&amp;f and www.x.y or xwwwy end",
    "<p class='a'>one</p><br/>two < three > four",
    "no markup at all",
]


def expected(value, *patterns):
    if value is None:
        return ""
    value = html.unescape(value)
    for pattern in patterns:
        value = re.sub(pattern, " ", value)
    return re.sub(r"\s+", " ", value).strip()


@pytest.mark.parametrize(
    "cleaner, patterns",
    [
        (text.clean_encyclopedia, [text.CITATION_NUMBER_OR_EDIT]),
        (text.clean_abstract, [text.CITATION_LIST]),
        (text.clean_html, [text.HTML_TAG, text.URL]),
    ],
)
def test_cleaners_agree_with_python_patterns(spark, cleaner, patterns):
    rows = spark.createDataFrame(list(enumerate(EDGE_TEXTS)), "i int, t string")
    got = {r["i"]: r["c"] for r in rows.select("i", cleaner(F.col("t")).alias("c")).collect()}
    assert got == {i: expected(t, *patterns) for i, t in enumerate(EDGE_TEXTS)}


def test_length_bound_is_strict_and_counts_code_points(spark):
    rows = spark.createDataFrame([("é" * 100,), ("é" * 101,), ("😀" * 101,)], "text string")
    kept = clean_documents(rows, "encyclopedia").collect()
    assert sorted(len(r["clean_text"]) for r in kept) == [101, 101]


def test_unknown_cleaning_style_is_refused(spark):
    with pytest.raises(ValueError):
        clean_documents(spark.createDataFrame([("a",)], "text string"), "latex")


def loop_windows(n, max_len, stride, min_len):
    out, start = [], 0
    while start < n:
        end = min(start + max_len, n)
        if end - start >= min_len:
            out.append((start, end))
        if end == n:
            break
        start += stride
    return out


@pytest.mark.parametrize(
    "max_len, stride, min_len", [(500, 150, 120), (40, 55, 15), (10, 10, 1), (7, 3, 5), (5, 100, 1), (3, 1, 3)]
)
def test_windows_follow_the_loop(spark, max_len, stride, min_len):
    sizes = [0, 1, 2, 5, 9, 10, 11, 39, 40, 41, 54, 55, 56, 95, 96, 119, 120, 121, 499, 500, 501, 650, 651, 1999]
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in sizes]
    frame = spark.createDataFrame(rows, "n int, clean_text string")
    got = chunk_documents(frame, keep=["n"], max_len=max_len, stride=stride, min_len=min_len, max_tokens=10_000)
    found = {}
    for r in got.orderBy("n", "chunk_id").collect():
        words = r["chunk_text"].split(" ")
        first = int(words[0][1:])
        assert r["chunk_tokens"] == len(words) and words == [f"w{i}" for i in range(first, first + len(words))]
        found.setdefault(r["n"], []).append((first, first + len(words)))
        assert r["chunk_id"] == len(found[r["n"]]) - 1
    assert found == {n: w for n in sizes if (w := loop_windows(n, max_len, stride, min_len))}


def test_upper_bound_on_tokens(spark):
    frame = spark.createDataFrame([(" ".join("w" * 900),)], "clean_text string")
    assert chunk_documents(frame, keep=[], max_len=900, max_tokens=800).count() == 0


def test_tokens_of_uncleaned_text(spark):
    rows = spark.createDataFrame([(" a\t b\n\nc ",), ("  ",), (None,)], "t string")
    got = [r[0] for r in rows.select(text.tokenise(F.col("t"))).collect()]
    assert got[0] == ["a", "b", "c"] and got[1] == []


def test_empty_string_counts_as_missing_text(spark):
    rows = spark.createDataFrame([("", " ", "p"), (None, None, "p"), ("c", "t", "p"), ("", None, None)], "chunk_text string, text string, preview string")
    assert [r[0] for r in rows.select(text.pick_text(rows.columns)).collect()] == [" ", "p", "c", ""]


def test_hashing_encoder_memory_does_not_grow_with_the_batch():
    def peak(n):
        texts = pa.array([" ".join(f"w{(i * j) % 997}" for j in range(500)) for i in range(n)] + [None, ""])
        encode = hashing_encoder().__closure__[0].cell_contents.func
        tracemalloc.start()
        try:
            found = encode(texts)
            return tracemalloc.get_traced_memory()[1] - found.nbytes, found.to_pylist()
        finally:
            tracemalloc.stop()

    small, few = peak(500)
    large, many = peak(4000)
    assert large < 2 * small and many[:500] == few[:500] and many[-2:] == few[-2:]


def test_hashing_encoder_edge_texts(spark):
    rows = spark.createDataFrame([(0, "a b a"), (1, "b  A a"), (2, ""), (3, None), (4, "ß é")], "i int, t string")
    got = {r[0]: r[1] for r in rows.select("i", hashing_encoder(16)(F.col("t"))).collect()}
    assert got[0] == pytest.approx(got[1])
    assert sum(x * x for x in got[0]) == pytest.approx(1.0, abs=1e-6)
    assert got[2] == got[3] == [0.0] * 16
    assert sum(x * x for x in got[4]) == pytest.approx(1.0, abs=1e-6)


def test_model_encoder_takes_a_users_model(spark):
    def make():
        import numpy as np

        def predict(texts):
            return np.array([[len(t), t.count("a")] for t in texts.reshape(-1)], dtype=np.float32)

        return predict

    rows = spark.createDataFrame([("banana",), ("kiwi",)], "t string")
    got = [r[0] for r in rows.select(model_encoder(make, 8)(F.col("t"))).collect()]
    assert got == [[6.0, 3.0], [4.0, 0.0]]

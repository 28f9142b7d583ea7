"""Entities are decoded as by the standard library, without a Python worker."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from passel.functions.text import unescape_html


def check(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    got = {r.i: r.d for r in frame.select("i", unescape_html(F.col("t")).alias("d")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if t is not None and got[i] != html.unescape(t)]
    assert wrong == []
    return got


def test_every_name(spark):
    bare = [n.removesuffix(";") for n in html5]
    check(spark, [f"a &{n} b" for n in html5] + [f"&{n}" for n in bare] + [f"x&{n}y;&{n}&amp{n};" for n in bare])


def test_numbers(spark):
    numbers = [*range(0, 700), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600]
    numbers += [0x1FFFE, 0x2FFFF, 0x10FFFD, 0x10FFFE, 0x10FFFF, 0x110000, 99999999, 123456789012345678901234567890]
    texts = [f"&#{n};|&#x{n:x};|&#X{n:X}|&#{n}" for n in numbers] + ["&#0000000000065;&#x00000000041;", "&#;&#x;&#xg;&# 65;&;&&lt;"]
    check(spark, texts)


def test_odd_texts(spark):
    pick = random.Random(4)
    parts = ["&", ";", "#", "x", "amp", "lt", "notit", "eacute", "frac12", "copy", "CounterClockwiseContourIntegral", " ", "é", "\n", "65", "12A", "<", "&#", "&amp;"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 14))) for _ in range(1500)]
    got = check(spark, [*texts, "", "&amp;eacute;", "&lt;b&gt; &quot;", "&notanentity;", "&" + "x" * 70 + ";"])
    assert unescape_html is not None and got[len(texts)] == ""
    null = spark.createDataFrame([(None,)], "t string").select(unescape_html(F.col("t")).alias("d")).first()
    assert null.d is None


def test_cleaning_needs_no_python_worker(spark):
    text = F.format_string("a &eacute; b %d", F.col("id")).alias("text")
    docs = spark.range(3).select(text)
    plan = docs.select(unescape_html(F.col("text")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "PythonUDF" not in plan

"""Quality and licences on rows that were held out, and the pipeline as a whole."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passel.llm.licenses import OTHERS, TEMPLATES, UNKNOWN, LicenceModel, scan_licences, train, words_of
from passel.llm.quality import FEATURES, Classifier, features, fit_classifier, score_quality, site_priors
from passel.llm.registered import QUERIES

DOCS = "doc_id long, text string, lang string, source string, p_good string"


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    own = labels.where("doc_id % 2 = 0")
    scored = score_quality(docs, fit_classifier(docs, own)).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = scored.select("quality", "keep").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert len(bad) > 20 and np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_fit_is_bounded_and_steady(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    few = fit_classifier(docs, labels, rows=30)
    again = fit_classifier(docs.repartition(5), labels.repartition(3), rows=30)
    assert np.allclose(few.weights, again.weights)


def test_quality_of_edge_rows(spark):
    rows = [(1, None, None, None), (None, "", "en", "s"), (2, "fine words " * 3000, None, "s"), (2, "x\n\n|||", "en", None), (3, "\0", "en", "s")]
    docs = spark.createDataFrame([(*r, "own") for r in rows], DOCS)
    none = fit_classifier(docs, spark.createDataFrame([(9, 1), (None, 0), (1, None)], "doc_id long, quality int"))
    found = score_quality(docs, none).collect()
    assert len(found) == len(rows) and all(r.keep and 0 < r.p_good < 1 for r in found)
    assert score_quality(docs.limit(0), none).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = ["", "one", "ÉÀ WORD!! a|b", "x " * 100, "12\n34"]
    together = features(texts)
    assert together.shape == (5, len(FEATURES)) and np.isfinite(together).all()
    for text, row in zip(texts, together):
        assert np.array_equal(features([text])[0], row)


def test_features_of_slices(monkeypatch):
    texts = ["one one two\n two É!! | " * 40, "a", " " * 50]
    whole = features(texts)
    monkeypatch.setattr("passel.llm.quality.SLICE", 5)
    assert np.allclose(features(texts), whole)


def test_classifier_without_two_classes():
    rows = np.ones((4, 3))
    assert Classifier(rows, np.ones(4)).log_odds(rows)[0] == pytest.approx(math.log(5))
    assert Classifier(np.empty((0, 3)), np.empty(0)).log_odds(rows)[0] == 0


def test_priors_shrink_sparse_sites(spark):
    """Sites of many documents speak for themselves, sparse ones follow the level above; computed again in NumPy."""
    chance = random.Random(2)
    rows = [(h, f"/{p}", min(0.99, max(0.01, chance.gauss(m, 0.1)))) for h, m, n in (("good", 0.9, 400), ("bad", 0.2, 400), ("mixed", 0.5, 300)) for p in "ab" for _ in range(n)]
    rows += [("bad", "/rare", 0.9), ("new", "/a", 0.05), (None, "/a", 0.5)]
    frame = spark.createDataFrame(rows, "host string, path string, p double")
    sites, share, n_sites = site_priors(frame)
    got = {(r.host, r.path): (r.host_prior, r.prior) for r in sites.collect()}
    known = [r for r in rows if r[0]]

    def strength(key):
        groups = {}
        for r in known:
            groups.setdefault(key(r), []).append(r[2])
        n = np.array([len(g) for g in groups.values()], float)
        means = np.array([np.mean(g) for g in groups.values()])
        centre = np.average(means, weights=n)
        variance = max(sum(np.sum((np.array(g) - np.mean(g)) ** 2) for g in groups.values()), 1e-9) / (n.sum() - len(n))
        between = (np.sum(n * (means - centre) ** 2) - (len(n) - 1) * variance) / (n.sum() - (n**2).sum() / n.sum())
        return centre, variance / max(between, 1e-9), groups

    centre, weight, hosts = strength(lambda r: r[0])
    _, path_weight, paths = strength(lambda r: r[:2])
    assert share == pytest.approx(centre) and n_sites == len(paths) == len(got)
    for (host, path), own in paths.items():
        above = (sum(hosts[host]) + weight * centre) / (len(hosts[host]) + weight)
        assert got[host, path][0] == pytest.approx(above)
        assert got[host, path][1] == pytest.approx((sum(own) + path_weight * above) / (len(own) + path_weight))
    assert got["bad", "/rare"][1] < 0.9 and got["bad", "/a"][1] < 0.25 < 0.85 < got["good", "/a"][1]


@pytest.fixture(scope="module")
def model(spark, tables):
    return train(spark.read.parquet(f"{tables}/documents.parquet"))


def test_licences_of_held_out_variants(model):
    """Statements with words lost, spoilt or added that the model was not fitted on."""
    chance, right, rows = random.Random(99), 0, 0
    for family, templates in model.templates.items():
        for template in templates:
            for _ in range(10):
                words = LicenceModel._varied(template, OTHERS, chance)
                rows += 1
                right += model.classify(words)[0] == family
    assert right > 0.93 * rows


def test_other_sentences_are_unknown(model):
    others = ["She reserved all rights to the story of her life.", "the general public of the free commons", "MIT is a school, CC a key.", ""]
    for text in OTHERS + others:
        family, p = model.classify(words_of(text))
        assert family == UNKNOWN or p < 0.5 or model.compare(words_of(text), family) < 0.8, text


def test_probabilities_are_calibrated(model):
    chance, sure, hits = random.Random(7), [], []
    for family, templates in model.templates.items():
        for template in templates:
            for _ in range(20):
                found, p = model.classify(LicenceModel._varied(template, OTHERS, chance))
                sure.append(p)
                hits.append(found == family)
    assert abs(np.mean(sure) - np.mean(hits)) < 0.06


def test_scan_equals_paragraph_by_paragraph(spark, tables):
    """All statements of the tables are found and confirmed; nothing else is."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    known = {t for ts in TEMPLATES.values() for t in ts}
    want = {(r.doc_id, i) for r in docs.collect() for i, line in enumerate(r.text.split("\n")) if line in known}
    found = {(r.doc_id, r.paragraph) for r in QUERIES["op4_licences"](spark, tables).collect() if r.confirmed}
    assert want and found == want


def test_scan_of_edge_rows(spark, model):
    text = "some words\nReleased under the MIT License.\n" + "filler words of a page " * 20000 + "\nAll rights reserved."
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, text), (3, text)]
    docs = spark.createDataFrame([(i, t, None, "s", "own") for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.paragraph, r.family, r.confirmed) for r in scan_licences(docs, model).collect()), key=repr)
    three = [(3, 1, "mit", True), (3, 3, "all-rights-reserved", True)]
    assert got == sorted([*three, *three, (None, 0, "mit", True)], key=repr)
    assert scan_licences(docs.limit(0), train(docs.limit(0))).count() == 0


def test_stages_of_the_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number < 4:
            assert out.columns == names and out.dtypes == docs.dtypes
            before, after = docs.count(), out.count()
            assert after < before if number in (0, 2) else after == before
            assert out.where(F.length("text") != F.col("n_chars")).count() == 0
            docs = spark.createDataFrame(out.collect(), docs.schema)
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_whole_pipeline(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())

"""The quality query, and sites taken from urls, computed again in plain Python."""

import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from passel.llm import quality
from passel.llm.quality import Classifier, score_quality
from passel.llm.registered import QUERIES

SIGNS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:'\"()-", b"|", b"!?", b"$%&*#@^~_+=<>[]{}\\/`"]


def numbers(text):
    """Features, counted byte by byte and word by word."""
    data = text.encode()
    n = [sum(b in s for b in data) for s in SIGNS]
    lower, upper, digit, _, lines, mark, bar, shout, sign = n
    other = len(data) - sum(n)
    accented = sum(a == 0xC3 and 0x80 <= b < 0x9F for a, b in zip(data, data[1:]))
    size = max(len(data), 1)
    row = [math.log(1 + len(data)), (upper + accented) / max(lower + upper + other / 2, 1)]
    row += [c / size for c in (digit, mark, bar, shout, sign, other)]
    words = text.split()
    if not words:
        return row + [0.0] * 5
    most = max(words.count(w) for w in set(words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    variety = math.log(len(set(words))) / math.log(len(words) + 1)
    return row + [min(len(data) / len(words), 50), math.log(len(words) / (lines + 1) + 1), same / len(words), variety, most / len(words)]


def fitted(rows, good):
    """Weights of least penalised loss, by Newton's method with halved steps."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9

    def inputs(x):
        z = np.clip((x - mean) / scale, -6, 6)
        return np.hstack([z, z**2, np.ones((len(z), 1))])

    x, w = inputs(rows), np.zeros(2 * rows.shape[1] + 1)
    ridge = np.array([1.0] * (len(w) - 1) + [1e-9])

    def loss(w):
        return np.logaddexp(0, x @ w).sum() - good @ (x @ w) + (ridge * w * w).sum() / 2

    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - good) + ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), slope)
        size = 1.0
        while size > 1e-9 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return lambda rows: np.clip(inputs(rows) @ w, -15, 15)


def shrunk(groups):
    """Centre and weight of a prior over groups of probabilities, by the method of moments."""
    n, k = sum(map(len, groups)), len(groups)
    centre = sum(map(sum, groups)) / n
    means = [sum(g) / len(g) for g in groups]
    within = max(sum((p - m) ** 2 for g, m in zip(groups, means) for p in g), 1e-9) / max(n - k, 1)
    spread = sum(len(g) * (m - centre) ** 2 for g, m in zip(groups, means))
    between = max((spread - (k - 1) * within) / max(n - sum(len(g) ** 2 for g in groups) / n, 1e-9), 1e-9)
    return centre, min(within / between, 1e6)


def posterior(odds, sites):
    """Prior and posterior of each document from its odds and its site (host, path)."""
    p = [1 / (1 + math.exp(-o)) for o in odds]
    hosts, paths = defaultdict(list), defaultdict(list)
    for own, (host, path) in zip(p, sites):
        if host is not None:
            hosts[host].append(own)
            paths[host, path].append(own)
    share, weight = shrunk(list(hosts.values()))
    _, path_weight = shrunk(list(paths.values()))

    def logit(q):
        q = max(min(q, 1 - 1e-6), 1e-6)
        return math.log(q / (1 - q))

    out = []
    for own, odd, (host, path) in zip(p, odds, sites):
        prior = share
        if host is not None:
            above = (sum(hosts[host]) + weight * share) / (len(hosts[host]) + weight)
            prior = (sum(paths[host, path]) + path_weight * above) / (len(paths[host, path]) + path_weight)
        out.append((own, prior, 1 / (1 + math.exp(-(odd - logit(share) + logit(prior))))))
    return out


def test_query(spark, tables):
    docs, labels = (pq.read_table(f"{tables}/{name}.parquet").to_pylist() for name in ("documents", "labels"))
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    x = {i: numbers(t) for i, t in texts.items()}
    own = {r["doc_id"]: float(r["quality"] > 0) for r in labels if r["quality"] is not None and r["doc_id"] in texts}
    model = fitted(np.array([x[i] for i in own]), np.array([*own.values()]))
    odds = model(np.array([x[d["doc_id"]] for d in docs]))
    want = posterior(odds.tolist(), [(d["source"], d["lang"]) for d in docs])
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, tables).collect()}
    assert len(got) == len(docs) and 0 < sum(r.keep for r in got.values()) < len(docs)
    for d, (p_text, prior, p_good) in zip(docs, want):
        r = got[d["doc_id"]]
        assert (r.p_text, r.prior, r.p_good) == pytest.approx((p_text, prior, p_good), rel=1e-4, abs=1e-6)
        assert r.keep == (p_good >= 0.5)


@pytest.mark.parametrize("most", [100_000, 0])
def test_sites_of_urls(spark, tables, monkeypatch, most):
    """On ``pages``, with sites broadcast or shuffled; columns of the names of the new ones are replaced."""
    monkeypatch.setattr(quality, "BROADCAST_SITES", most)
    labels = np.array([1.0, 0.0] * 4)
    model = Classifier(np.array([numbers("fine words of a page " * i) if i % 2 else numbers("!! |" * i) for i in range(8)]), 1 - labels)
    pages = spark.read.parquet(f"{tables}/pages.parquet").selectExpr("page_id", "url", "html", "'a' as p_text", "1 as prior", "'x' as Keep")
    rows = pages.collect()
    got = {r[0]: r for r in score_quality(pages, model, text_col="html", url_col="url").collect()}
    assert len(got) == len(rows)

    def site(url):
        host, _, path = url.split("://", 1)[1].partition("/")
        return host.lower(), path.split("?")[0].split("#")[0].split("/")[0]

    odds = model.log_odds(np.array([numbers(r.html or "") for r in rows])).tolist()
    for r, want in zip(rows, posterior(odds, [site(r.url) for r in rows])):
        own = got[r.page_id]
        assert (own.p_text, own.prior, own.p_good) == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_urls_without_a_host(spark):
    docs = spark.createDataFrame([(1, "x", None), (2, "y", "no url"), (3, "z", "http://[bad"), (3, "z", "http://h/a/b")], "id long, text string, url string")
    got = score_quality(docs, Classifier(np.empty((0, 13)), np.empty(0)), url_col="url", columns=["id"]).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 3] and all(r.keep for r in got)
    assert score_quality(docs.limit(0), Classifier(np.empty((0, 13)), np.empty(0)), url_col="url").count() == 0

"""Document quality from the text and from the site: a trained classifier within a hierarchy of empirical Bayes priors.

The classifier gives each document a probability from its text alone. Grouped sums of these probabilities give each host,
and each path below it, a posterior share of good documents; sites with few documents are shrunk towards the level
above. That share replaces the global one as the prior of the site's documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passel.llm.tables import ROW, checkpoint, released, stored, tidy

# Labelled rows that the classifier is fitted on at most.
TRAINING_ROWS = 20_000
# Sites whose priors are broadcast at most; more are joined by shuffle.
BROADCAST_SITES = 100_000
# Posterior probability of good quality from which a document is kept.
KEEP_FROM = 0.5
# Characters that are counted at once.
SLICE = 1 << 22
BLANK = re.compile(r"\s")

# Kinds of bytes: other, lower case, upper case, digit, blank, line end, stop or comma, bar, exclamation mark, other sign, lead of two bytes.
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:'\"()-", b"|", b"!?", b"$%&*#@^~_+=<>[]{}\\/`"], 1):
    _KIND[list(_bytes)] = _kind
KINDS = 10
FEATURES = ["log_bytes", "upper", "digit", "mark", "bar", "shout", "sign", "other", "word_bytes", "line_words", "repeated", "distinct", "most_frequent"]


def _slices(text: str) -> Iterator[str]:
    """A text in pieces of about ``SLICE`` characters, cut at white space."""
    start = 0
    while start < len(text):
        blank = BLANK.search(text, start + SLICE)
        end = blank.start() if blank else len(text)
        yield text[start:end]
        start = end


def _numbers(text: str) -> list[float]:
    counts, size, accented, repeated, last = np.zeros(KINDS), 0, 0, 0, None
    words: Counter[str] = Counter()
    for piece in _slices(text):
        data = np.frombuffer(piece.encode(), np.uint8)
        size += len(data)
        counts += np.bincount(_KIND[data], minlength=KINDS)
        # Accented capitals of the Latin supplement: the second byte after 0xC3 is below 0x9F.
        accented += int(((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)).sum())
        own = piece.split()
        words.update(own)
        repeated += sum(a == b for a, b in zip([last, *own], own))
        last = own[-1] if own else last
    letters = max(counts[1] + counts[2] + counts[0] / 2, 1)
    shares = [counts[kind] / max(size, 1) for kind in (3, 6, 7, 8, 9, 0)]
    row = [math.log1p(size), (counts[2] + accented) / letters, *shares]
    if not (n := words.total()):
        return row + [0.0] * 5
    # Fewer distinct words than a text of this length has, and more of the most frequent one, speak of repetition.
    variety = math.log(len(words)) / math.log(n + 1)
    return row + [min(size / n, 50), math.log(n / (counts[5] + 1) + 1), repeated / n, variety, max(words.values()) / n]


def features(texts: Iterable[str]) -> np.ndarray:
    """One row of numbers for each text, most of them shares of its bytes or words."""
    return np.array([_numbers(t) for t in texts]).reshape(-1, len(FEATURES))


class Classifier:
    """Logistic regression over standardised features; constant where there is nothing to tell apart."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, ridge: float = 1.0, rounds: int = 30):
        share = (good.sum() + 1) / (len(good) + 2)
        self.mean, self.scale = np.zeros(rows.shape[1]), np.ones(rows.shape[1])
        self.weights = np.array([*np.zeros(self._width(rows.shape[1])), math.log(share / (1 - share))])
        if not len(good) or good.all() or not good.any():
            return
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
        x, penalty = self._inputs(rows), ridge * np.eye(len(self.weights))
        penalty[-1, -1] = 1e-9
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (good - p) - penalty @ self.weights
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, slope)
            self.weights += np.clip(step, -5, 5)

    @staticmethod
    def _width(n: int) -> int:
        return 2 * n

    def _inputs(self, rows: np.ndarray) -> np.ndarray:
        """Standardised features, their squares, and a constant."""
        z = np.clip((rows - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self._inputs(rows) @ self.weights, -15, 15)


def fit_classifier(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS
) -> Classifier:
    """Fit on up to ``rows`` labelled documents, chosen by the hash of their id; null labels and ids don't count."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc"), (F.col(f"`{label_col}`") > 0).cast("double").alias("good")).dropna()
    chosen = known.groupBy("doc").agg(F.max("good").alias("good")).orderBy(F.xxhash64("doc"), "doc").limit(rows)

    @F.arrow_udf("array<double>")
    @tidy
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array(features(t.as_py() or "" for t in texts).tolist(), pa.list_(pa.float64()))

    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    # The chosen rows are bounded by the parameter.
    found = texts.join(F.broadcast(chosen), "doc").select(numbers("text").alias("x"), "good").toArrow()
    x = found.column("x").combine_chunks()
    return Classifier(x.flatten().to_numpy().reshape(len(x), len(FEATURES)), found.column("good").to_numpy())


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> tuple[float, float, int]:
    """Of groups (n, total, squares) of probabilities: their mean, the prior's weight in documents, and their number.

    The weight is the variance within groups by the variance of the groups' true means, by the method of moments.
    """
    mean = F.col("total") / F.col("n")
    within = F.col("squares") - F.col("total") * mean
    n, total, inside, count = groups.agg(F.sum("n"), F.sum("total"), F.sum(within), F.count("*")).first()
    if not n:
        return 0.5, 1.0, 0
    centre = total / n
    (spread,) = groups.agg(F.sum(F.col("n") * (mean - centre) * (mean - centre))).first()
    variance = max(inside, 1e-9) / max(n - count, 1)
    (weights,) = groups.agg(F.sum(F.col("n") * F.col("n"))).first()
    between = (spread - (count - 1) * variance) / max(n - weights / n, 1e-9)
    return centre, min(variance / max(between, 1e-9), 1e6), count


def site_priors(scored: DataFrame) -> tuple[DataFrame, float, int]:
    """Posterior shares of good documents for every ``host`` and ``path`` in ``scored``, the global share, the number of paths.

    ``scored`` has a row per document with its probability ``p``. Sums are formed where the rows lie, so a host of every
    third document is a few rows.
    """
    sums = [F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")]
    paths = checkpoint(scored.where("host is not null").groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    share, weight, _ = _strength(hosts)
    _, path_weight, n_paths = _strength(paths)
    host_prior = (F.col("total") + weight * share) / (F.col("n") + weight)
    above = hosts.select(F.col("host").alias("of"), host_prior.alias("host_prior"))
    prior = (F.col("total") + path_weight * F.col("host_prior")) / (F.col("n") + path_weight)
    return paths.join(above, F.col("host") == F.col("of")).select("host", "path", "host_prior", prior.alias("prior")), share, n_paths


def site_of_url(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and first part of the path of a url; a host of null where it can't be read."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH"))
    return host, F.regexp_extract(path, "^/([^/]*)", 1)


def score_quality(
    docs: DataFrame,
    classifier: Classifier,
    host_col: str = "source",
    path_col: str = "lang",
    text_col: str = "text",
    keep_from: float = KEEP_FROM,
    url_col: str | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """All rows with ``p_text``, the classifier's probability of good quality, ``prior``, that of the site,
    ``p_good``, the posterior probability, and ``keep``.

    ``columns`` are the input columns handed on, by default all. The site is ``host_col`` and ``path_col``, or host and
    first part of the path of ``url_col`` where that is given. Texts are read once: the columns handed on are stored
    with the odds of the text, in the shared folder, and the priors come from there.

    A null text is empty. Rows without a host have the global prior; a null path is a path of its own. Repeated rows
    are scored each, and count each for their site; an empty table gives an empty one. Input columns called like the
    new ones are replaced.
    """

    @F.arrow_udf("double")
    @tidy
    def log_odds(texts: pa.Array) -> pa.Array:
        return pa.array(classifier.log_odds(features(t.as_py() or "" for t in texts)))

    columns = docs.columns if columns is None else columns
    if url_col is None:
        host, path = F.col(f"`{host_col}`").cast("string"), F.col(f"`{path_col}`").cast("string")
    else:
        host, path = site_of_url(F.col(f"`{url_col}`").cast("string"))
    # A null path must meet itself in the join.
    path = F.coalesce(F.concat(F.lit("/"), path), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias(ROW)
    rows, _ = stored(docs.select(row, host.alias("host"), path.alias("path"), log_odds(F.col(f"`{text_col}`")).alias("odds")))
    p = 1 / (1 + F.exp(-F.col("odds")))
    sites, share, n_sites = site_priors(rows.select("host", "path", p.alias("p")))
    sites = F.broadcast(sites) if n_sites <= BROADCAST_SITES else sites
    prior = F.coalesce("prior", F.lit(share))
    joined = rows.join(sites, ["host", "path"], "left")
    good = 1 / (1 + F.exp(-(F.col("odds") - _logit(F.lit(share)) + _logit(prior))))
    return released(joined, columns, p_text=p, prior=prior, p_good=good, keep=good >= keep_from)

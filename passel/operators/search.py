"""One search function over interchangeable strategies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passel.operators.hits import filter_after, source_matches
from passel.operators.topk import (
    BROADCAST_BYTES,
    BROADCAST_QUERIES,
    Scoring,
    keep_best_per_uid,
    rank_hits,
    topk,
)

# How many times k is fetched before a later filter, and per shard before the merge.
OVERFETCH = 4
ALPHA = 3

FILTER_STAGES = ("pre", "post", "merge", "local")


@dataclass(frozen=True)
class SearchOptions:
    """The knobs of a search; every strategy reads the ones it needs."""

    k: int = 10
    metric: str = "ip"
    source: str | None = None
    filter_stage: str = "pre"
    overfetch: int = OVERFETCH
    alpha: int = ALPHA
    dedup: bool = True
    shard: str = "shard"
    carry: tuple[str, ...] = ()
    max_query_rows: int = BROADCAST_QUERIES
    max_query_bytes: int = BROADCAST_BYTES
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.filter_stage not in FILTER_STAGES:
            raise ValueError(f"filter_stage must be one of {FILTER_STAGES}")
        if self.overfetch < 1 or self.alpha < 1:
            raise ValueError("overfetch and alpha must be at least 1")

    def carried(self) -> tuple[str, ...]:
        """Columns that go with the hits; the source only where a later filter needs it."""
        late = self.source is not None and self.filter_stage != "pre" and "source" not in self.carry
        return (*self.carry, "source") if late else self.carry

    def limits(self) -> dict[str, int]:
        return {"max_rows": self.max_query_rows, "max_bytes": self.max_query_bytes}


Strategy = Callable[[DataFrame, DataFrame, SearchOptions], DataFrame]


def encode_queries(queries: DataFrame, encoder: Callable[[Column], Column], text: str = "query") -> DataFrame:
    return queries.withColumn("embedding", encoder(F.col(text)))


def prefiltered(corpus: DataFrame, options: SearchOptions) -> DataFrame:
    """The corpus of the wanted source when the filter comes before the scoring."""
    if options.source is None or options.filter_stage != "pre":
        return corpus
    return corpus.where(source_matches(F.col("source"), options.source))


def exact(queries: DataFrame, corpus: DataFrame, options: SearchOptions) -> DataFrame:
    """Score the whole corpus. A late filter works on ``overfetch * k`` candidates."""
    late = options.source is not None and options.filter_stage != "pre"
    fetch = options.k * options.overfetch if late else options.k
    scoring = Scoring(fetch, options.metric, options.dedup)
    found = topk(queries, prefiltered(corpus, options), scoring, options.carried(), **options.limits())
    return filter_after(found, options.source, options.k) if late else found


def _shard_candidates(queries: DataFrame, corpus: DataFrame, options: SearchOptions) -> DataFrame:
    scoring = Scoring(options.k * options.alpha, options.metric, distinct_uids=False, per_bucket=True)
    found = topk(queries, prefiltered(corpus, options), scoring, options.carried(), options.shard, **options.limits())
    return found.withColumnRenamed("rank", "shard_rank")


def sharded(queries: DataFrame, corpus: DataFrame, options: SearchOptions) -> DataFrame:
    """The best ``k * alpha`` of every shard, merged, then filtered, deduplicated, ranked and cut."""
    candidates = _shard_candidates(queries, corpus, options)
    return _merge_shards(candidates, options)


def fan_out(queries: DataFrame, corpus: DataFrame, options: SearchOptions) -> DataFrame:
    """As ``sharded``, always with the best occurrence of a uid and the filter inside the shard."""
    candidates = _shard_candidates(queries, corpus, options)
    return _merge_shards(candidates, options, always_dedup=True)


def _merge_shards(candidates: DataFrame, options: SearchOptions, always_dedup: bool = False) -> DataFrame:
    late = options.source is not None and options.filter_stage != "pre"
    if late:
        candidates = candidates.where(source_matches(F.col("source"), options.source))
    carry = [*options.carried(), options.shard]
    if always_dedup or options.dedup:
        candidates = keep_best_per_uid(candidates, ["qid"], carry)
    else:
        candidates = candidates.select("qid", "score", "uid", *carry)
    return rank_hits(candidates, options.k)


STRATEGIES: dict[str, Strategy] = {"exact": exact, "sharded": sharded, "fanout": fan_out}
EXTRA_OPTIONS: dict[str, frozenset[str]] = {}


def register_strategy(name: str, strategy: Strategy, extra_options: Sequence[str] = ()) -> None:
    """Add a strategy or replace one, with the names of the options only it knows."""
    STRATEGIES[name] = strategy
    EXTRA_OPTIONS[name] = frozenset(extra_options)


def search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    strategy: str = "exact",
    carry: Sequence[str] = (),
    **options: Any,
) -> DataFrame:
    """Ranked hits ``(qid, score, uid, rank, carried columns)`` of all queries.

    ``queries`` holds ``qid`` and ``embedding``; ``corpus`` holds ``uid``, ``embedding`` and, for
    filters, ``source``. Keyword options are those of :class:`SearchOptions` and of the strategy.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {sorted(STRATEGIES)}")
    known = {n: v for n, v in options.items() if n in SearchOptions.__dataclass_fields__}
    extra = {n: v for n, v in options.items() if n not in known}
    unknown = set(extra) - EXTRA_OPTIONS.get(strategy, frozenset())
    if unknown:
        raise ValueError(f"strategy {strategy!r} has no option {sorted(unknown)}")
    settings = SearchOptions(k=k, carry=tuple(carry), extra=extra, **known)
    return STRATEGIES[strategy](queries, corpus, settings)


def search_one(query: str, encoder: Callable[[Column], Column], corpus: DataFrame, **options: Any) -> DataFrame:
    """Search a single text."""
    if not query.strip():
        raise ValueError("the query is empty")
    one = corpus.sparkSession.createDataFrame([(0, query)], "qid long, query string")
    return search(encode_queries(one, encoder), corpus, **options)


def search_many(queries: DataFrame, encoder: Callable[[Column], Column], corpus: DataFrame, **options: Any) -> DataFrame:
    """Search a table of texts ``(qid, query)``."""
    return search(encode_queries(queries, encoder), corpus, **options)

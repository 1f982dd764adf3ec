"""Sources mixed to target shares of tokens by balanced sampling with the cube method.

The largest mixture that keeps all shares gives every document of a source the same expected number of uses. Its whole
part is certain; the fraction is an inclusion probability. The flight phase moves the probabilities of three documents of a source at a
time along the null space of the two balancing totals, tokens and documents, until one is 0 or 1. It runs in every partition on its
own and leaves at most two documents per partition and source; what is left flies again in fewer partitions until there is one, and only the
last two documents of a source are landed at random.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonargrid.session import checkpoint

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public vocabulary's texts are split before its merges apply.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one flight, that is of one partition.
FLIGHT = 20_000
_EPS = 1e-9


def _token_kernel(vocabulary: str, pattern: str):
    """(doc_id, source, text) -> (doc_id, source, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with an id and a text; the source in lower case without outer spaces. Repeated rows stay."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    return rows.mapInArrow(_token_kernel(vocabulary, pattern), "doc_id bigint, source string, n_tokens bigint")


class Flight:
    """The flight phase over a stream of units (id, tokens, probability) of one source; decided units go to ``out``."""

    def __init__(self, seed: int) -> None:
        self.pool: list[list] = []
        self.out: list[tuple[int, int]] = []
        self.random = random.Random(seed)

    def add(self, unit: int, tokens: int, p: float) -> None:
        self.pool.append([unit, tokens, p])
        while len(self.pool) >= 3:
            self._move()

    def _settled(self) -> None:
        keep = []
        for u in self.pool:
            if u[2] < _EPS or u[2] > 1 - _EPS:
                self.out.append((u[0], int(u[2] > 0.5)))
            else:
                keep.append(u)
        self.pool = keep

    def _move(self) -> None:
        """One step in the null space of (1, tokens) over the first three units; it decides at least one of them."""
        self._settled()
        if len(self.pool) < 3:
            return
        a, b, c = self.pool[:3]
        direction = [c[1] - b[1], a[1] - c[1], b[1] - a[1]]
        if not any(direction):
            direction = [1, -1, 0]
        self._step(self.pool[:3], direction)

    def _step(self, units: list[list], direction: list) -> None:
        up = min(((1 - u[2]) / d if d > 0 else u[2] / -d) for u, d in zip(units, direction) if d)
        down = min((u[2] / d if d > 0 else (1 - u[2]) / -d) for u, d in zip(units, direction) if d)
        t = up if self.random.random() * (up + down) < down else -down
        for u, d in zip(units, direction):
            u[2] = min(1.0, max(0.0, u[2] + t * d))
        self._settled()

    def land(self) -> None:
        """Decide the last units: two keep the number of documents, one keeps nothing but its probability."""
        self._settled()
        while len(self.pool) > 1:
            self._step(self.pool[:2], [1, -1])
        for u in self.pool:
            self.out.append((u[0], int(self.random.random() < u[2])))
        self.pool = []


def _flight_kernel(seed: int, land: bool = False):
    """(doc_id, source, n_tokens, p) in order of doc_id -> the same with p of 0 or 1, or between for what is left; nothing is left if it is to ``land``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flights: dict[str, Flight] = {}
        sizes: dict[int, int] = {}
        names = ["doc_id", "source", "n_tokens", "p"]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=names)

        for b in batches:
            for doc, source, n, p in zip(*(c.to_pylist() for c in b.columns)):
                f = flights.get(source)
                if f is None:
                    f = flights[source] = Flight(hash((seed, doc)))
                sizes[doc] = n
                f.add(doc, n, p)
            rows = [(d, s, sizes.pop(d), float(x)) for s, f in flights.items() for d, x in f.out]
            for f in flights.values():
                f.out = []
            if rows:
                yield pack(rows)
        for f in flights.values():
            f.land() if land else f._settled()
        rows = [(d, s, sizes.pop(d), float(x)) for s, f in flights.items() for d, x in f.out]
        yield pack(rows + [(u[0], s, u[1], u[2]) for s, f in flights.items() for u in f.pool])

    return run


def sizes_by_source(counts: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens): one row per document with tokens and a source; of several rows of a document the least counts."""
    one = counts.where("n_tokens > 0 AND source IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d"))
    return one.select("doc_id", "d.source", "d.n_tokens")


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 7, flight: int = FLIGHT) -> DataFrame:
    """(doc_id, source, n_tokens, uses): how often each document is used, at most the source's ``max_repeats``; 0 is left out.

    ``targets`` (source, target_share, max_repeats) is a short list of sources, the shares of which sum to 1. The size of the mixture
    is the largest at which no source has to repeat more than it may. Documents without id, text, tokens or listed source are
    not used. A target without documents leaves no mixture, and the result is empty. The same rows give the same
    result on any cluster, and again after a lost executor.
    """
    goals = targets.where("target_share > 0 AND max_repeats > 0").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    sizes = checkpoint(sizes_by_source(token_counts(documents, vocabulary)))  # a few numbers a document; texts are read and tokenised once
    totals = goals.join(sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "source", "left").collect()  # one row a target
    schema = "doc_id bigint, source string, n_tokens bigint, p double"
    spark = documents.sparkSession
    if not totals or any(not t.tokens for t in totals):
        return spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, uses int")
    whole = min(t.repeats * t.tokens / t.share for t in totals)
    plan = []
    for t in totals:
        uses = min(float(t.repeats), whole * t.share / t.tokens)
        sure = int(uses + _EPS)
        plan.append((t.source, sure, max(0.0, uses - sure) if uses - sure > _EPS else 0.0))
    rows = sizes.join(F.broadcast(spark.createDataFrame(plan, "source string, sure int, p double")), "source")
    share = max(flight, 16 * len(plan))  # so that every round leaves a small part of what it took
    open_, left = rows.where("p > 0").select("doc_id", "source", "n_tokens", "p"), sum(t.docs for t, (_, _, p) in zip(totals, plan) if p)
    taken = []
    while True:
        parts = max(1, left // share)
        flown = checkpoint(open_.repartition(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_flight_kernel(seed, parts == 1), schema))
        taken.append(flown.where("p = 1").select("doc_id"))
        if parts == 1:
            break
        open_ = flown.where("p > 0 AND p < 1")
        left = open_.count()
    chosen = taken[0]
    for t in taken[1:]:
        chosen = chosen.unionByName(t)
    chosen = chosen.withColumn("extra", F.lit(1))
    return rows.join(chosen, "doc_id", "left").select("doc_id", "source", "n_tokens", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("uses")).where("uses > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, most_uses, tokens, share): what each target reached in a mixture."""
    goals = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.max("uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    rows = goals.join(got, "source", "left").withColumn("of", F.sum("tokens").over(Window.partitionBy()))  # a row per target
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("source", "target_share", "max_repeats", zero("docs"), zero("most_uses"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("of"), F.lit(0.0)).alias("share"))

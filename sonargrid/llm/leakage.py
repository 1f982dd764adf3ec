"""Evaluation items leaking into documents.

The normalised words of the items form a generalised suffix automaton, which is sent to every executor; documents stream
past it and keep the longest match that ends at each word. Items come in shards of bounded size, built in tasks. A pass over
the documents takes a bounded number of shards along, so neither an automaton nor what is broadcast at a time grows with the
set of items; more items mean more passes.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonargrid.llm.automaton import SuffixAutomaton
from sonargrid.session import checkpoint

#: Words of items in one automaton, and automata of one pass over the documents.
SHARD_WORDS, SHARDS = 200_000, 8
_DRESS = re.compile(r"</?[A-Za-z!][^<>]*>|\[/?[A-Za-z*][^\[\]]*\]|&(?:[A-Za-z]\w*|#\d+|#[xX][0-9A-Fa-f]+);")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters or digits in lower case, without tags in angle or square brackets and entities."""
    return _WORD.findall(_DRESS.sub(" ", text).lower())


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) as in ``words``, with places in the text as it stands."""
    bare = _DRESS.sub(lambda m: " " * len(m[0]), text)
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(bare)]


class Matcher:
    """Longest matches of streamed words, and the items that hold the last ``least`` words.

    Items are kept at the states of ``least`` words only, so there are no more entries than words.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least: int) -> None:
        ids: dict[str, int] = {}
        coded = [(i, [ids.setdefault(w, len(ids)) for w in ws]) for i, ws in items]
        a = SuffixAutomaton()
        for i, ws in coded:
            a.add(ws, i)
        self.least, self.ids, self.next, self.link, self.len = least, ids, a.next, a.link, a.len
        self.top = list(range(len(a.link)))  # of the suffixes of a state that have ``least`` words, the state of the shortest
        for v in sorted(range(1, len(a.link)), key=a.len.__getitem__):
            if a.len[a.link[v]] >= least:
                self.top[v] = self.top[a.link[v]]
        owners: dict[int, set] = {}
        for i, ws in coded:
            v = 0
            for n, c in enumerate(ws, 1):
                v = a.next[v][c]
                if n >= least:
                    owners.setdefault(self.top[v], set()).add(i)
        self.owners = {v: tuple(sorted(o)) for v, o in owners.items()}

    def matches(self, ws: list[str]) -> Iterator[tuple[int, tuple]]:
        """(index of the last word, items) wherever ``least`` words of an item end."""
        nxt, link, length, least, ids = self.next, self.link, self.len, self.least, self.ids
        v = n = 0
        for i, w in enumerate(ws):
            c = ids.get(w)
            if c is None:
                v = n = 0
                continue
            t = nxt[v].get(c)
            while t is None and v:
                v = link[v]
                n = length[v]
                t = nxt[v].get(c)
            if t is None:
                n = 0
                continue
            v = t
            n += 1
            if n >= least:
                yield i, self.owners[self.top[v]]


def _part_kernel(least: int, size: int):
    """(item_id, text) -> (item_id, part, n, words): items of at least ``least`` words in parts of at most ``size``, which share ``least`` - 1 words, so that every window stands in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(text)
                out += [(item, a, len(ws[a : a + size]), ws[a : a + size]) for a in range(0, max(1, len(ws) - least + 1), size - least + 1) if len(ws[a : a + size]) >= least]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())))], names=["item_id", "part", "n", "words"])

    return run


def _build_kernel(least: int):
    """(shard, item_id, words) in order of shard -> (shard, blob): a pickled matcher for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(shard: int, items: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([pickle.dumps(Matcher(items, least))], pa.binary())], names=["shard", "blob"])

        at, items = None, []
        for b in batches:
            for shard, item, ws in zip(*(c.to_pylist() for c in b.columns)):
                if items and shard != at:
                    yield made(at, items)
                    items = []
                at = shard
                items.append((item, ws))
        if items:
            yield made(at, items)

    return run


def _over_items(documents: DataFrame, benchmark: DataFrame, least: int, size: int, kernel, schema: str) -> tuple[DataFrame, int]:
    """(rows of all passes, number of passes). A pass sends at most ``SHARDS`` automata of about ``size`` words; those of several passes are checkpointed, and their automata given up."""
    spark = documents.sparkSession
    context = spark.sparkContext
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text").distinct()
    parts = checkpoint(items.mapInArrow(_part_kernel(least, max(2 * least, size // 4)), "item_id bigint, part int, n int, words array<string>"))
    total = parts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], schema), 0
    shards = math.ceil(total / size)
    keyed = parts.withColumn("shard", F.pmod(F.xxhash64("item_id", "part"), F.lit(shards)))
    built = keyed.select("shard", "item_id", "words").repartition(min(shards, 200), "shard").sortWithinPartitions("shard", "item_id").mapInArrow(_build_kernel(least), "shard bigint, blob binary")
    if shards > 1:
        built = checkpoint(built)
    passes, sent = [], []

    def go(last: bool) -> None:
        rows = docs.mapInArrow(kernel(list(sent)), schema)
        if passes or not last:
            rows = checkpoint(rows)
            for s in sent:
                s.destroy()
        sent.clear()
        passes.append(rows)

    for row in built.toLocalIterator():  # one automaton at a time
        if len(sent) == SHARDS:
            go(last=False)
        sent.append(context.broadcast(pickle.loads(row.blob)))
    go(last=True)
    result = passes[0]
    for p in passes[1:]:
        result = result.unionByName(p)
    return result, len(passes)


def _spans(sent: list, ws: list[str]) -> dict[int, list[list[int]]]:
    """{item: [[first word, last word + 1], ..]}: maximal stretches all of whose windows of ``least`` words the item holds."""
    found: dict[int, list[list[int]]] = {}
    for s in sent:
        for i, owners in s.value.matches(ws):
            for item in owners:
                runs = found.setdefault(item, [])
                if runs and runs[-1][1] == i:
                    runs[-1][1] = i + 1
                else:
                    runs.append([i + 1 - s.value.least, i + 1])
    if len(sent) > 1:  # parts of an item may stand in several automata
        least = sent[0].value.least
        for item, runs in found.items():
            joined: list[list[int]] = []
            for a, e in sorted(runs):
                if joined and a <= joined[-1][1] - least + 1:
                    joined[-1][1] = max(joined[-1][1], e)
                else:
                    joined.append([a, e])
            found[item] = joined
    return found


def _span_kernel(sent: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                for item, runs in _spans(sent, words(text)).items():
                    out += [(doc, item, a, e) for a, e in runs]
            if out:
                cols = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "first_word", "end_word"])

    return run


def leaked_spans(documents: DataFrame, benchmark: DataFrame, least: int = 12, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word): stretches of a document all of whose windows of ``least`` words stand in an item.

    Null ids and texts, and items of fewer words, give nothing; repeated rows give repeated spans. Columns other than
    doc_id, item_id and text are ignored. Of an item that takes several passes a stretch may come in overlapping parts.
    """
    return _over_items(documents, benchmark, least, shard_words, _span_kernel, "doc_id bigint, item_id bigint, first_word int, end_word int")[0]


def leaks(documents: DataFrame, benchmark: DataFrame, least: int = 12, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id), distinct: documents in which at least ``least`` consecutive words of an item stand consecutively."""
    return leaked_spans(documents, benchmark, least, shard_words).select("doc_id", "item_id").distinct()


def _removal_kernel(sent: list):
    """(doc_id, text) -> (doc_id, text, cuts) of documents that leak: cuts in code points, in order."""
    kind = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                placed = placed_words(text)
                if runs := sorted({(a, e) for rs in _spans(sent, [w for w, _, _ in placed]).values() for a, e in rs}):
                    out.append((doc, text, [{"start_char": placed[a][1], "end_char": placed[e - 1][2]} for a, e in runs]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), kind))], names=["doc_id", "text", "cuts"])

    return run


def removed(documents: DataFrame, benchmark: DataFrame, least: int = 12, most_share: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text, leaked_chars, dropped) of every document that leaks: its text without the leaked spans.

    ``dropped`` is true, and the text null, where the spans cover more than ``most_share`` of the text's characters. Repeated
    rows give one row; a document with several texts has a row for each that leaks.
    """
    found, _ = _over_items(documents, benchmark, least, shard_words, _removal_kernel, "doc_id bigint, text string, cuts array<struct<start_char:int,end_char:int>>")
    rows = found.groupBy("doc_id", "text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("cuts"))  # of leaking documents alone
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"), F.lit(0).alias("cut"))

    def step(acc, c):
        a = F.greatest(acc["at"], c["start_char"])
        e = F.greatest(acc["at"], c["end_char"])
        kept = F.concat(acc["kept"], F.col("text").substr(acc["at"] + 1, a - acc["at"]))
        return F.struct(kept.alias("kept"), e.alias("at"), (acc["cut"] + e - a).alias("cut"))

    done = F.aggregate("cuts", start, step, lambda acc: F.struct(F.concat(acc["kept"], F.col("text").substr(acc["at"] + 1, F.length("text"))).alias("text"), acc["cut"].alias("cut")))
    rows = rows.select("doc_id", F.length("text").alias("n"), done.alias("d"))
    drop = F.col("d.cut") > most_share * F.col("n")
    return rows.select("doc_id", F.when(~drop, F.col("d.text")).alias("text"), F.col("d.cut").cast("bigint").alias("leaked_chars"), drop.alias("dropped"))

"""Operator 11: ranked lexical search for many items at once.

A document's score for an item is the sum, over the item's terms, of the term's
weight times a saturating function of its occurrences, all in integers.  The items
are evaluated together (multi-query common-subexpression evaluation):

1. ``sharing_plan`` mines the term sets that items share: terms that stand in
   exactly the same items form one class, and the pair of nodes that stands in
   most items is made a node of its own, again and again, until no pair stands
   in two items.  The nodes form a DAG: a node is the sum of two nodes;
2. one pass over the texts stores each document's number of terms and its
   occurrences of the items' terms (checkpointed, eight bytes a hit); the number
   of documents and terms and the document frequencies are summed from it;
3. for a slice of documents every class and node, that is every shared partial sum
   of a document, is materialised once, as one row of a matrix (an accumulator for
   each document), in the order of the DAG; an item adds the few nodes left to it;
4. a task keeps the best ``k`` documents of each item (a document that cannot pass
   the item's ``k``-th score is not kept), and the tasks' lists are merged in two steps.

Items are taken ``ITEM_BLOCK`` at a time, so what is broadcast (terms and DAG of one
block of items) does not grow with their number, nor with the documents.

Memory of a task: an accumulator matrix of ``MATRIX_CELLS`` integers (one document's
nodes at least), the best lists, and one text's term counts.

Edge cases: a null or empty document has no term, is not counted and never found; an
item without terms has no rows; rows of items with one id (null included) are
pooled, repeated document rows are found each by itself; equal scores go by
ascending id, null ids first; empty tables give an empty result; other columns of
both tables are left out.  Building the plan runs jobs (the items, the checkpoint
and the sums).
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.ascii_words import utf8, word_lists
from termweave.llm.common import checkpoint, ship_package

ITEM_BLOCK = 4_096
MATRIX_CELLS = 1 << 21
MERGE_WAYS = 256  # partial merges of an item's lists before the last one
NO_ID = -(1 << 63)
SCALE = 1_000_000_000


@dataclass(frozen=True)
class SharingPlan:
    """Classes of terms (node k < ``classes`` is class k), nodes that add two earlier
    nodes (by level, so that each level is one step), and each item's nodes."""

    terms: dict[bytes, int]
    class_of: np.ndarray
    classes: int
    levels: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]  # node, left, right
    items: tuple
    item_nodes: np.ndarray
    item_cuts: np.ndarray

    @property
    def nodes(self) -> int:
        return self.classes + sum(len(x[0]) for x in self.levels)


def sharing_plan(item_terms: dict[object, set[bytes]]) -> SharingPlan:
    """Mine shared term sets and lay out the DAG (see the module)."""
    items = tuple(i for i, terms in item_terms.items() if terms)
    held: dict[bytes, list[int]] = defaultdict(list)
    for k, item in enumerate(items):
        for term in sorted(item_terms[item]):
            held[term].append(k)
    number = {term: k for k, term in enumerate(sorted(held))}
    classes: dict[tuple, int] = {}
    class_of = np.array([classes.setdefault(tuple(held[term]), len(classes)) for term in number], np.int64)
    nodes_of: list[set[int]] = [set() for _ in items]
    where: dict[int, set[int]] = {}
    for where_in, c in classes.items():
        where[c] = set(where_in)
        for k in where_in:
            nodes_of[k].add(c)

    together: Counter = Counter()
    for own in nodes_of:
        shared = sorted(n for n in own if len(where[n]) > 1)
        together.update((a, b) for i, a in enumerate(shared) for b in shared[i + 1:])
    queue = [(-n, pair) for pair, n in together.items() if n > 1]
    heapq.heapify(queue)
    sums: list[tuple[int, int, int]] = []
    level = dict.fromkeys(range(len(classes)), 0)
    while queue:
        n, pair = heapq.heappop(queue)
        now = together[pair]
        if now != -n:  # counted anew since it was queued
            if now > 1:
                heapq.heappush(queue, (-now, pair))
            continue
        a, b = pair
        node, both = len(classes) + len(sums), where[a] & where[b]
        sums.append((node, a, b))
        level[node] = 1 + max(level[a], level[b])
        where[node] = both
        where[a], where[b] = where[a] - both, where[b] - both
        touched = set()
        for k in both:
            own = nodes_of[k]
            own -= {a, b}
            for other in own:
                if len(where[other]) > 1 or together[_pair(a, other)] or together[_pair(b, other)]:
                    together[_pair(a, other)] -= 1
                    together[_pair(b, other)] -= 1
                    together[_pair(node, other)] += 1
                    touched.add(_pair(node, other))
            own.add(node)
        together[pair] = 0
        for p in touched:
            if together[p] > 1:
                heapq.heappush(queue, (-together[p], p))

    deepest = max(level.values(), default=0)
    steps = tuple(tuple(np.array(x, np.int64) for x in zip(*[s for s in sums if level[s[0]] == d]))
                  for d in range(1, deepest + 1))
    cuts = np.cumsum([0, *map(len, nodes_of)])
    flat = np.array([n for own in nodes_of for n in sorted(own)], np.int64)
    return SharingPlan(number, class_of, len(classes), steps, items, flat, cuts)


def _pair(a: int, b: int) -> tuple[int, int]:
    return (a, b) if a < b else (b, a)


def query_terms(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """Number of terms of a text, and numbers and occurrences of the items' terms."""
    n, found = 0, Counter()
    for words in word_lists(text):
        n += len(words)
        found.update(words)
    hits = [(k, tf) for w, tf in found.items() if (k := vocabulary.get(w)) is not None]
    return n, [k for k, _ in hits], [tf for _, tf in hits]


def document_hits(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """``(doc_id, n, terms, times)`` of the documents with terms; packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value.terms
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [(i, *query_terms(text, known)) for i, text in
                        zip(part.column(0).to_pylist(), utf8(part.column(1)))]
                rows = [r for r in rows if r[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     *[pa.array([np.array(r[c], np.int32).tobytes() for r in rows], pa.binary()) for c in (2, 3)]],
                    names=["doc_id", "n", "terms", "times"])

    return checkpoint(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)
                      .mapInArrow(run, "doc_id long, n long, terms binary, times binary"))


def frequencies(hits: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each of the items' terms (one number a term to the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            total += np.bincount(flat, minlength=n_terms)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())],
                                         names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in hits.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(
            F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def accumulators(plan: SharingPlan, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores, one row an item and one column a document: the classes' and the shared
    nodes' partial sums are made once, the items add what is left."""
    sums = np.zeros((plan.nodes, n_docs), np.int64)
    np.add.at(sums, (plan.class_of[term], doc), value)
    for node, left, right in plan.levels:
        sums[node] = sums[left] + sums[right]
    return np.add.reduceat(sums[plan.item_nodes], plan.item_cuts[:-1], axis=0)


class Best:
    """The best ``k`` documents of each item, as far as seen."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.zeros(items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        # a score equal to the floor may win by its id
        item, at = np.nonzero((scores >= self.floor[:, None]) & (scores > 0))
        self.item = np.concatenate([self.item, item])
        self.score = np.concatenate([self.score, scores[item, at]])
        self.doc = np.concatenate([self.doc, docs[at]])
        order = np.lexsort((self.doc, -self.score, self.item))
        item = self.item[order]
        heads = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(heads, np.diff(np.append(heads, len(item))))
        order = order[place < self.k]
        self.item, self.score, self.doc = self.item[order], self.score[order], self.doc[order]
        full = place[place < self.k] == self.k - 1
        self.floor[self.item[full]] = self.score[full]


def best_of_block(hits: DataFrame, plan, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(item, doc_id, score, way)``: each task's best documents for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, weight = plan.value, weights.value
        best = Best(len(dag.items), k)
        rows = max(1, MATRIX_CELLS // max(1, dag.nodes))
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                # Python integers: the product may pass 64 bits before the division
                m = np.array([50 + (50 * n * n_docs) // n_terms for n in part.column(1).to_pylist()], np.int64)
                blobs = part.column(2).to_pylist()
                term = np.frombuffer(b"".join(blobs), np.int32)
                tf = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32).astype(np.int64)
                doc = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
                value = weight[term] * ((SCALE * tf) // (1000 * tf + 20 * m[doc]))
                best.add(accumulators(dag, doc, term, value, len(blobs)), ids)
        way = TaskContext.get().partitionId() % MERGE_WAYS
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int64()),
             pa.array(best.doc, pa.int64(), mask=best.doc == NO_ID),
             pa.array(best.score, pa.int64()), pa.array(np.full(len(best.item), way), pa.int32())],
            names=["item", "doc_id", "score", "way"])

    return hits.mapInArrow(run, "item long, doc_id long, score long, way int")


def _first(df: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, item_terms: dict, id_col: str, text_col: str, k: int, names: tuple) -> DataFrame:
    spark = docs.sparkSession
    dag = sharing_plan(item_terms)
    plan = spark.sparkContext.broadcast(dag)
    hits = document_hits(docs, id_col, text_col, plan)
    total = hits.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = total["n"], total["l"] or 0
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1)))
                       for df in frequencies(hits, len(dag.terms))], np.int64)
    shared = spark.sparkContext.broadcast(weight)
    best = _first(best_of_block(hits, plan, shared, n_docs, n_terms, k), k, "item", "way").drop("rank")
    ids = spark.createDataFrame(list(enumerate(dag.items)), names)  # at most ITEM_BLOCK rows
    return ids.join(_first(best, k, "item"), "item")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item, rank, doc, score)`` under the names ``item_col``, ``rank``, ``id_col``
    and ``score``: for each item the ``k`` documents with the highest score above 0."""
    ship_package(docs.sparkSession)
    keyed = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    n_items = keyed.select("item_id").distinct().count()
    blocks = -(-n_items // ITEM_BLOCK)
    kind = keyed.schema["item_id"].dataType
    out = None
    for b in range(blocks):
        pooled: dict[object, set[bytes]] = {}
        chosen = keyed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else keyed
        for r in chosen.toLocalIterator():
            terms = pooled.setdefault(r["item_id"], set())
            for words in word_lists((r["text"] or "").encode()):
                terms.update(words)
        if any(pooled.values()):
            names = f"item long, item_id {kind.simpleString()}"
            found = _search_block(docs, pooled, id_col, text_col, k, names)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"),
                      F.col("doc_id").alias(id_col), "score")

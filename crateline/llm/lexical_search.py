"""Ranked lexical search of many items at once, with shared term sets summed only once.

The items' terms are cut into blocks of bounded size. Inside a block, sets of terms that several
items share are mined: an item is a sequence of its terms in the order of how many items hold
them, and pairs of neighbours that repeat become nodes of a graph, again and again, until nothing
repeats. A document's accumulator of a node is the sum of its two parts, so a shared set is summed
once for all items that hold it; items add up the nodes that are left in their sequences. The
documents are read as postings of the blocks' terms, a stretch of documents at a time.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_step, discard, store, table
from .registry import query

#: Terms are what these bytes leave together; UTF-8 bytes of other characters than ASCII belong to terms.
_TO_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Pairs of an item and a term in one block, and bytes of plans that are sent to the tasks at once.
BLOCK_TERMS, PLAN_BYTES = 1 << 14, 8 << 20
#: Cells (nodes by documents) of one matrix of accumulators, and postings of one stretch of documents.
CELLS, POSTINGS = 1 << 22, 1 << 19
SALTS = 64


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, as UTF-8."""
    return (text or "").encode().translate(_TO_TERMS).split()


@dataclass(frozen=True)
class Plan:
    """The graph of one block: leaves (a term and how often an item has it), then nodes of two parts by level, then the items' lists of nodes."""

    terms: list[bytes]
    leaf_term: np.ndarray
    leaf_times: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    items: list[int]
    parts: np.ndarray
    starts: np.ndarray

    @property
    def n_nodes(self) -> int:
        return len(self.leaf_term) + sum(len(left) for left, _ in self.levels)


def mine(items: list[tuple[int, list[tuple[bytes, int]]]]) -> Plan:
    """Plan items given by their number and their (term, times) pairs; every item has a term."""
    held = Counter(pair for _, pairs in items for pair in pairs)
    leaves = {pair: i for i, pair in enumerate(sorted(held, key=lambda p: (-held[p], p)))}
    terms = {term: i for i, term in enumerate(sorted({term for term, _ in leaves}))}
    sizes = np.array([len(pairs) for _, pairs in items])
    nodes = np.array([i for _, pairs in items for i in sorted(map(leaves.__getitem__, pairs))], np.int64)
    owner, n, levels = np.repeat(np.arange(len(items)), sizes), len(leaves), []
    while len(nodes) > 1:
        inside = owner[1:] == owner[:-1]
        pair = np.where(inside, (nodes[:-1] << 32) | nodes[1:], -1)
        _, at, uses = np.unique(pair, return_inverse=True, return_counts=True)
        uses = np.where(inside, uses[at], 0)
        # A pair is taken where it beats the pairs that overlap it; equal uses are told apart by the pair itself.
        rank = np.lexsort((pair, uses)).argsort() if len(pair) else uses
        order = np.where(uses > 1, rank, -1)
        beats = (order > np.concatenate([[-1], order[:-1]])) & (order > np.concatenate([order[1:], [-1]]))
        chosen, back, times = np.unique(pair[beats], return_inverse=True, return_counts=True)
        good = times > 1
        if not good.any():
            break
        number = np.cumsum(good) - 1 + n
        first = np.flatnonzero(beats)[good[back]]
        levels.append((chosen[good] >> 32, chosen[good] & 0xFFFFFFFF))
        nodes[first] = number[back][good[back]]
        n += int(good.sum())
        stays = np.ones(len(nodes), bool)
        stays[first + 1] = False
        nodes, owner = nodes[stays], owner[stays]
    starts = np.searchsorted(owner, np.arange(len(items) + 1))
    return Plan(list(terms), np.array([terms[t] for t, _ in leaves], np.int64), np.array([k for _, k in leaves], np.int64), levels, [i for i, _ in items], nodes, starts)


def accumulate(plan: Plan, contribution: np.ndarray) -> np.ndarray:
    """Scores, items by documents, from what each term adds to each document (terms by documents)."""
    sums = np.empty((plan.n_nodes, contribution.shape[1]), np.int64)
    n = len(plan.leaf_term)
    np.multiply(contribution[plan.leaf_term], plan.leaf_times[:, None], out=sums[:n])
    for left, right in plan.levels:
        np.add(sums[left], sums[right], out=sums[n:n + len(left)])
        n += len(left)
    scores = np.empty((len(plan.items), contribution.shape[1]), np.int64)
    for i in range(len(plan.items)):
        sums[plan.parts[plan.starts[i]:plan.starts[i + 1]]].sum(axis=0, out=scores[i])
    return scores


def _items(items: DataFrame, item_id: str, text_col: str) -> DataFrame:
    """Items in a stored table, numbered, with their (term, times) pairs and a digest of them."""
    def split(step):
        ids, texts = step.columns
        bags = [sorted(Counter(terms_of(t)).items()) for t in texts.to_pylist()]
        keys = [xxhash.xxh3_128_digest(b" ".join(b"%b %d" % pair for pair in b)) for b in bags]
        least = [min((xxhash.xxh3_64_digest(t) for t, _ in b), default=b"") for b in bags]  # alike items tend to have it in common
        return pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(least), pa.array([len(b) for b in bags], pa.int64()),
                                           pa.array([[t for t, _ in b] for b in bags], pa.list_(pa.binary())), pa.array([[k for _, k in b] for b in bags], pa.list_(pa.int64()))],
                                          ["item_id", "key", "least", "size", "terms", "times"])
    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return arrow_step(named, split, "item_id long, key binary, least binary, size long, terms array<binary>, times array<long>")


def _plans(bags: DataFrame, block_terms: int) -> DataFrame:
    """Plans (``plan`` binary, ``n_bytes``) over the distinct bags of terms, each of about ``block_terms`` pairs."""
    total = bags.agg(F.sum("size")).first()[0] or 0
    near = bags.repartitionByRange(max(1, -(-total // (8 * block_terms))), "least", "key").sortWithinPartitions("least", "key")

    def run(batches):
        waiting, size = [], 0

        def made():
            data = pickle.dumps(tuple(vars(mine(waiting)).values()))
            return pa.RecordBatch.from_arrays([pa.array([data]), pa.array([len(data)], pa.int64())], ["plan", "n_bytes"])
        for batch in batches:
            for number, terms, times in zip(*(batch.column(c).to_pylist() for c in ("number", "terms", "times")), strict=True):
                waiting.append((number, list(zip(terms, times, strict=True))))
                size += len(terms)
                if size >= block_terms:
                    yield made()
                    waiting, size = [], 0
        if waiting:
            yield made()
    return near.select("number", "terms", "times").mapInArrow(run, "plan binary, n_bytes long")


def postings(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its number of terms and its (term, times) pairs among ``terms``, the terms as their places in the list."""
    known = {t: i for i, t in enumerate(terms)}

    def count(step):
        ids, texts = step.columns
        n, codes, ends = [], [], [0]
        for text in texts.to_pylist():
            words = terms_of(text)
            n.append(len(words))
            found = [known[w] for w in words if w in known]
            codes += found
            ends.append(len(codes))
        owner = np.repeat(np.arange(len(n)), np.diff(ends))
        cells, times = np.unique(owner * max(1, len(known)) + np.array(codes, np.int64), return_counts=True)
        owner, term = np.divmod(cells, max(1, len(known)))
        at = pa.array(np.searchsorted(owner, np.arange(len(n) + 1)), pa.int32())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(term, pa.int32())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))],
                                          ["doc_id", "n", "terms", "times"])
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_step(named, count, "doc_id long, n long, terms array<int>, times array<long>")


def _statistics(held: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and for each listed term the documents that hold it."""
    def count(batches):
        df, n, size = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            sizes = np.asarray(batch.column(0))
            n, size = n + int((sizes > 0).sum()), size + int(sizes.sum())
            df += np.bincount(np.asarray(pa.compute.list_flatten(batch.column(1))), minlength=n_terms)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *found.tolist()], pa.int64()), pa.array([n, size, *df[found].tolist()], pa.int64())], ["term", "n"])
    told = dict(held.select("n", "terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row for each term of the plans at most
    return told.get(-2, 0), told.get(-1, 0), np.array([told.get(t, 0) for t in range(n_terms)], np.int64)


def weights(n_docs: int, holding: np.ndarray) -> np.ndarray:
    """A term's weight from the number of documents and of those that hold it."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * holding + 1))).astype(np.int64)


def _best(held: DataFrame, plans: list[tuple[Plan, np.ndarray]], weight: np.ndarray, n_docs: int, n_all: int, top: int, b: int) -> DataFrame:
    """The ``top`` rows of each item among the documents of each task."""
    n_items = sum(len(p.items) for p, _ in plans)
    numbers = np.array([i for p, _ in plans for i in p.items], np.int64)

    def stretches(batch):
        ends = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column(2))))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS, side="right")))
            yield batch.slice(at, upto - at).columns
            at = upto

    def run(batches):
        least = np.ones(n_items, np.int64)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

        def keep(rows):
            item, score, null, doc = (np.concatenate(c) for c in zip(best, *rows, strict=True))
            order = np.lexsort((doc, ~null, -score, item))
            item, score, null, doc = item[order], score[order], null[order], doc[order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            best[:] = [c[place < top] for c in (item, score, null, doc)]
            last = place == top - 1
            least[item[last]] = score[last]
        for batch in batches:
            for doc, n, term, times in stretches(batch):
                null, doc, n = np.asarray(doc.is_null()), np.asarray(doc.fill_null(0)), np.asarray(n)
                ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(term)))])
                term, times = np.asarray(pa.compute.list_flatten(term)), np.asarray(pa.compute.list_flatten(times))
                most = 100 - b + (b * n * n_docs) // max(1, n_all)
                owner = np.repeat(np.arange(len(n)), np.diff(ends))
                adds = weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * most[owner]))
                rows, waiting, base = [], 0, 0
                for plan, place in plans:  # terms of the whole list, at their places in this plan
                    own_term, wide = place[term], max(1, CELLS // plan.n_nodes)
                    for at in range(0, len(n), wide):
                        upto = min(len(n), at + wide)
                        part = np.arange(ends[at], ends[upto])[own_term[ends[at]:ends[upto]] >= 0]
                        contribution = np.zeros((len(plan.terms), upto - at), np.int64)
                        contribution[own_term[part], owner[part] - at] = adds[part]
                        scores = accumulate(plan, contribution)
                        item, found = np.nonzero(scores >= least[base:base + len(plan.items), None])
                        rows.append((item + base, scores[item, found], null[at + found], doc[at + found]))
                        waiting += len(item)
                        if waiting > 1 << 17:
                            keep(rows)
                            rows, waiting = [], 0
                    base += len(plan.items)
                if rows:
                    keep(rows)
        item, score, null, doc = best
        yield pa.RecordBatch.from_arrays([pa.array(numbers[item]), pa.array(score), pa.array(doc, pa.int64(), mask=null)], ["number", "score", "doc_id"])
    return held.select("doc_id", "n", "terms", "times").mapInArrow(run, "number long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, top: int = 10, b: int = 75, block_terms: int = BLOCK_TERMS, plan_bytes: int = PLAN_BYTES,
           id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` documents of each item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of all other characters than ASCII, A-Z
    lower-cased. Scores are sums over an item's terms with repeats of
    ``w * (1000000000 tf div (1000 tf + 8 m))``, ``w = floor(1000 ln((2N+2)/(2df+1)))``,
    ``m = 100-b + (b n N) div L``, in 64-bit integers. Equal scores go by ascending id, a null id
    first. Rules for odd input: null and empty texts have no terms; a document or an item without
    terms is in no row; each row that repeats an id is a document, or an item, of its own (the
    ranks of each such item begin at 1); an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    named, path = store(_items(items, item_id, item_text).filter("size > 0").withColumn("row", F.monotonically_increasing_id()), "search-items")
    # Items of equal terms are planned once.
    first = named.groupBy("key").agg(F.min("row").alias("number"))
    bags = named.join(first.select(F.col("number").alias("row"), "number"), "row", "left_semi").withColumnRenamed("row", "number")
    plans, plan_path = store(_plans(bags, block_terms).withColumn("at", F.monotonically_increasing_id()), "search-plans")
    groups, size = [[]], 0
    for row in plans.select("at", "n_bytes").orderBy("at").collect():  # two numbers for each block
        if groups[-1] and size + row["n_bytes"] > plan_bytes:
            groups.append([])
            size = 0
        groups[-1].append(row["at"])
        size += row["n_bytes"]
    made = []
    for group in groups:
        taken = [Plan(*pickle.loads(r["plan"])) for r in plans.filter(F.col("at").isin(group)).select("plan").collect()]  # plan_bytes, or one plan
        if not taken:
            continue
        terms = sorted({t for p in taken for t in p.terms})
        code = {t: i for i, t in enumerate(terms)}
        placed = []
        for p in taken:
            place = np.full(len(terms), -1, np.int64)
            place[[code[t] for t in p.terms]] = np.arange(len(p.terms))
            placed.append((p, place))
        held, held_path = store(postings(docs, terms, id_col, text_col), "search-postings")
        n_docs, n_all, holding = _statistics(held, len(terms))
        if not n_docs:
            discard(spark, held_path)
            continue
        best, _ = store(_best(held.filter(F.size("terms") > 0), placed, weights(n_docs, holding), n_docs, n_all, top, b), "search-best")
        discard(spark, held_path)
        made.append(best)
    discard(spark, plan_path)
    whole = reduce(DataFrame.unionByName, made, spark.createDataFrame([], "number long, score long, doc_id long"))
    # The tasks' best rows of an item meet in parts first.
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    parts = whole.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    parts = parts.withColumn("place", F.row_number().over(Window.partitionBy("number", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= top)
    rows = named.select("item_id", "key").join(first, "key").select("item_id", "number")
    return rows.join(ranked, "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), sized AS (SELECT doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
 total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sized),
 item AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
 tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS t FROM sized) WHERE t IN (SELECT t FROM item) GROUP BY doc_id, n, t),
 w AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t),
 adds AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS s FROM tf JOIN w USING (t), total),
 scored AS (SELECT item_id, doc_id, sum(k * s)::BIGINT AS score FROM item JOIN adds USING (t) GROUP BY item_id, doc_id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query("op13_lexical_search", SQL)
def op13_lexical_search(spark, folder):
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

"""Language-model scoring by Katz backoff.

Counts of n-grams are discounted by Good-Turing below ``most + 1``; the mass they give up, divided
by the lower model's mass of the words not seen after a context, is the context's weight, so each
context's probabilities sum to one over the known words and one unknown word.

``P(w | h)`` is the discounted share of ``w`` after ``h`` if that was seen, else the weight of ``h``
times ``P(w | shorter h)``; after a context that was never seen it is ``P(w | shorter h)`` itself.
Below single words stands an even share of the V known words and the unknown one.

Documents are coded in chunks; the tables of n-gram counts and of context weights are partitioned
by hash, and the chunks look up their own distinct n-grams there (see ``exchange``). A level's
counts and sums cover all training documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_tokens, columns_of, discard, hash_tokens, mixed, remainder, steps, store, table, words_of
from .exchange import MESSAGE, answer, ask, gather, joined, packed, rows, slices, unpacked
from .registry import query

#: Text bytes of a chunk and n-grams of a bucket.
CHUNK_BYTES, BUCKET_GRAMS = 12 << 20, 3_000_000
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_BODY = "chunk long, n_tokens long, docs binary, sizes binary, train binary, at binary, words binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents coded in chunks: sizes, training marks, each token's place among the chunk's distinct token hashes."""
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for step in steps(batches, most=CHUNK_BYTES):
            ids, texts, train = (step.column(k) for k in range(3))
            tokens, at, sizes = code_tokens([words_of(t) for t in texts.to_pylist()])
            hashes = hash_tokens(tokens)
            keys, order = np.unique(hashes, return_inverse=True)
            missing = np.asarray(ids.is_null())
            body = (order[at] if len(at) else at).astype(np.uint32)
            yield rows([((part << 32) + number, int(sizes.sum() + len(sizes)), packed(np.asarray(ids.fill_null(0)), missing.view(np.uint8)), packed(sizes),
                         packed(np.asarray(train.cast(pa.uint8()))), packed(body), packed(keys))], _BODY)
            number += 1
    return docs.mapInArrow(run, _BODY)


class _Chunk:
    """A chunk's tokens, each document's ending with its end."""

    def __init__(self, row: dict):
        self.row = row
        self.ids, self.missing = unpacked(row["docs"])
        (self.sizes,), (train,), (at,), (words,) = (unpacked(row[k]) for k in ("sizes", "train", "at", "words"))
        self.sizes = self.sizes + 1
        self.stop = np.cumsum(self.sizes)
        self.tokens = np.full(int(self.sizes.sum()), _END, np.uint64)
        inner = np.ones(len(self.tokens), bool)
        inner[self.stop - 1] = False
        self.tokens[inner] = words[at]
        self.train = np.repeat(train.astype(bool), self.sizes)

    def grams(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``level``-gram that ends at each token, and of the context before it."""
        context = np.full(len(self.tokens), level, np.uint64)
        place = np.arange(len(self.tokens)) - np.repeat(self.stop - self.sizes, self.sizes)
        for back in range(level - 1, 0, -1):
            earlier = np.full(len(self.tokens), _START, np.uint64)
            inside = place >= back
            earlier[inside] = self.tokens[np.flatnonzero(inside) - back]
            context = mixed(context * np.uint64(0x9E3779B97F4A7C15) + earlier)
        return mixed(context * np.uint64(0x9E3779B97F4A7C15) + self.tokens), context

    def distinct(self, level: int):
        """Distinct n-grams in ascending order, where each token's is, their contexts and training counts."""
        key, context = self.grams(level)
        keys, first, at = np.unique(key, return_index=True, return_inverse=True)
        return keys, at, context[first], np.bincount(at, self.train, len(keys)).astype(np.int64)


def _count(messages: list[list[np.ndarray]]) -> list[tuple]:
    """For each chunk: the total of each of its n-grams, and whether it is the first chunk that has it."""
    keys, counts = (np.concatenate(c) for c in zip(*messages, strict=True))
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    totals = np.zeros(len(first), np.int64)
    np.add.at(totals, at, counts)
    told, own = totals[at], np.zeros(len(keys), np.uint8)
    own[first] = 1
    cuts = np.cumsum([len(m[0]) for m in messages])[:-1]
    return list(zip(np.split(told, cuts), np.split(own, cuts), strict=True))


def _sums(messages: list[list[np.ndarray]]) -> list[tuple]:
    """For each chunk and each of its contexts: sums over all chunks."""
    keys, *sums = (np.concatenate(c) for c in zip(*messages, strict=True))
    _, at = np.unique(keys, return_inverse=True)
    told = [np.bincount(at, s)[at] for s in sums]
    cuts = np.cumsum([len(m[0]) for m in messages])[:-1]
    return list(zip(*(np.split(t, cuts) for t in told), strict=True))


def discounts(n: dict[int, int], most: int) -> np.ndarray:
    """Katz's factor for each count up to ``most``; n[r] n-grams were seen r times. Counts whose factor is not within 0 and 1 stay whole."""
    factor = np.ones(most + 1)
    common = (most + 1) * n.get(most + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, most + 1):
        if n.get(r) and common < 1:
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common)
            factor[r] = d if 0 < d < 1 else 1.0
    return factor


def _kept_counts(count: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return count * factor[np.where(count < len(factor), count, 0)]


def weights(total: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The divisor of a context's counts and its backoff weight, from its count, its discounted count and the lower mass of its words.

    A context whose counts all stay whole has one more count in its divisor, so that it keeps mass for other words.
    """
    divisor = np.where(kept < total, total, total + 1.0)
    return divisor, (1 - kept / divisor) / np.maximum(1 - lower, 1e-300)


def _counts_of_counts(answers: DataFrame, most: int) -> tuple[dict[int, int], int, int]:
    """How many n-grams have each small count, the sum of all counts, and the number of n-grams."""
    def run(batches):
        n = np.zeros(most + 4, np.int64)
        for batch in batches:
            for data in batch.column(0):
                totals, own = unpacked(data.as_py())
                seen = totals[(own == 1) & (totals > 0)]
                n[:most + 2] += np.bincount(np.minimum(seen, most + 2), minlength=most + 3)[:most + 2]
                n[-2:] += seen.sum(), len(seen)
        yield rows([(r, int(v)) for r, v in enumerate(n)], "r int, n long")
    n = dict(answers.select("data").mapInArrow(run, "r int, n long").groupBy("r").agg(F.sum("n")).collect())  # ``most`` + 4 rows
    return {r: n.get(r, 0) for r in range(1, most + 2)}, n.get(most + 2, 0), n.get(most + 3, 0)


def _with(chunks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Chunks and their answers as rows of one shape."""
    made = chunks.withColumn("kind", F.lit("body"))
    for kind, df in answers.items():
        made = made.unionByName(df.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return made


def score(docs: DataFrame, order: int = 2, most: int = 5, hold_out: int = 2, folds: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probability of every text under a model of the documents outside the held-out fold.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Tokens are the
    text's words and one end; the first words' contexts reach back to a start that is no token.
    Rules for odd input: null text is its end alone; a null id counts as empty text when folds are
    dealt; rows that repeat an id are documents of their own; with nothing to train on every token
    has the even share of the unknown word, 1; an empty table gives no rows.
    """
    spark, rows_in = docs.sparkSession, columns_of(docs, id_col, text_col)
    marked = rows_in.select("doc_id", "text", (remainder(F.col("doc_id"), folds) != hold_out).alias("train"))
    chunks, _ = store(_chunks(marked), "chunks")
    size = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_GRAMS)
    lower = known = None
    for level in range(1, order + 1):
        asked = ask(chunks, lambda row, level=level: _question(row, level), buckets)
        counts, counts_path = store(answer(asked, _count, buckets), f"counts-{level}")
        n, tokens, types = _counts_of_counts(counts, most)
        factor = discounts(n, most)
        if level == 1:
            known, total, vocabulary = counts, tokens, types
        held = _with(chunks, counts=counts) if lower is None else _with(chunks, counts=counts, lower=lower)

        def sums_of(chunk, held, level=level, factor=factor, vocabulary=vocabulary):
            found = _Level(held, level, factor, vocabulary)
            return [(bucket, chunk, packed(*parts)) for bucket, parts in found.context_sums(buckets)]

        sums = answer(gather(held, "chunk", sums_of, MESSAGE), _sums, buckets)
        contexts, contexts_path = store(sums, f"contexts-{level}")
        held = held.unionByName(contexts.withColumn("kind", F.lit("contexts")), allowMissingColumns=True)
        if level < order:
            def lower_of(chunk, held, level=level, factor=factor, vocabulary=vocabulary):
                return [(0, chunk, packed(_Level(held, level, factor, vocabulary).probabilities()))]
            made, path = store(gather(held, "chunk", lower_of, MESSAGE), f"lower-{level}")
            discard(spark, contexts_path, *([] if level == 1 else [counts_path, lower_path]))
            lower, lower_path = made, path

    def scores_of(chunk, held):
        return _Level(held, order, factor, vocabulary).scores(total, vocabulary)

    held = held.unionByName(known.withColumn("kind", F.lit("known")), allowMissingColumns=True)
    return gather(held, "chunk", scores_of, _SCORES)


def _question(row: dict, level: int):
    keys, _, _, counts = _Chunk(row).distinct(level)
    return keys, counts


class _Level:
    """One chunk at one level of the model."""

    def __init__(self, held: list[dict], level: int, factor: np.ndarray, vocabulary: int):
        self.told = {kind: joined([r for r in held if r["kind"] == kind]) for kind in {r["kind"] for r in held} - {"body"}}
        self.chunk, self.level = _Chunk(next(r for r in held if r["kind"] == "body")), level
        self.keys, self.at, self.context, _ = self.chunk.distinct(level)
        self.totals, self.own = self.told["counts"]
        self.kept = _kept_counts(self.totals, factor)
        if level == 1:
            self.lower = np.full(len(self.keys), 1 / (vocabulary + 1))
        else:  # of each n-gram without its first word, by any token that ends it
            _, first = np.unique(self.at, return_index=True)
            shorter = np.unique(self.chunk.grams(level - 1)[0], return_inverse=True)[1]
            self.lower = self.told["lower"][0][shorter[first]]
        self.contexts, self.of = np.unique(self.context, return_inverse=True)

    def context_sums(self, buckets: int):
        """For each context of the chunk: count, discounted count and lower mass of the n-grams that this chunk answers for."""
        own = (self.own == 1) & (self.totals > 0)
        sums = [np.bincount(self.of[own], v[own], len(self.contexts)) for v in (self.totals, self.kept, self.lower)]
        return [(bucket, (self.contexts[a:b], *(s[a:b] for s in sums))) for bucket, a, b in slices(self.contexts, buckets)]

    def probabilities(self) -> np.ndarray:
        """Of each distinct n-gram's last word after the rest."""
        total, kept, lower = (v[self.of] for v in self.told["contexts"])
        divisor, weight = weights(total, kept, lower)
        return np.where(total == 0, self.lower, np.where(self.totals > 0, self.kept / divisor, weight * self.lower))

    def scores(self, tokens: int, vocabulary: int) -> list[tuple]:
        chunk = self.chunk
        count = self.told["known"][0][np.unique(chunk.grams(1)[0], return_inverse=True)[1]]
        starts = chunk.stop - chunk.sizes
        model = np.add.reduceat(np.log10(self.probabilities())[self.at], starts)
        base = np.add.reduceat(np.log10((count + 1) / (tokens + vocabulary + 1)), starts)
        seen = np.add.reduceat((count > 0).astype(np.int64), starts)
        held_out = ~chunk.train[starts]
        return [(None if m else i, h, n, k, tokens, b, s) for i, m, h, n, k, b, s in zip(
            chunk.ids.tolist(), chunk.missing.tolist(), held_out.tolist(), chunk.sizes.tolist(), seen.tolist(), base.tolist(), model.tolist(), strict=True)]


@query("op10_katz_scores")
def op10_katz_scores(spark, folder):
    return score(table(spark, folder, "documents"))

"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, found by the forward algorithm;
the pieces' probabilities are learned by expectation maximisation with the same sums. A text is
scored by all its words: runs of letters, lower-cased, with a mark for the word's start.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_step, code_tokens, columns_of, kept, remainder, store, table
from .registry import query

#: Longer runs of letters are scored in cuts of this length.
LONGEST = 24
#: Words of one generation of a worker's memo; there are two.
MEMO = 60_000
_MARK = "▁"
_MIX = 0x9E3779B97F4A7C15
#: Letters and, beyond ASCII, numerals that are none; those are cut out afterwards.
_RUN = re.compile(r"[^\W\d_]+")


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; runs longer than ``LONGEST`` in cuts."""
    found = []
    runs = _RUN.findall((text or "").lower())
    if not all(map(str.isalpha, runs)):
        runs = [part for run in runs for part in "".join(c if c.isalpha() else " " for c in run).split()]
    for run in runs:
        if len(run) <= LONGEST:
            found.append(run)
        else:
            found.extend(run[a:a + LONGEST] for a in range(0, len(run), LONGEST))
    return found


def load_pieces(path: str) -> dict[str, int]:
    """Pieces of the vocabulary that can occur in a word, numbered from 2; 0 is no piece and 1 any unknown character."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    usable = sorted({p for p in names if p and p == p.lower() and (p.removeprefix(_MARK) or "a").isalpha() and _MARK not in p[1:]})
    return {p: i for i, p in enumerate(usable, 2)}


class Lattice:
    """Forward and backward sums over the segmentations of many words at once.

    Pieces are found by a 64-bit hash of their signs, in an open-addressing table, for a whole
    column of spans at a time; what lies beyond every piece's beginning is not looked up.
    """

    def __init__(self, pieces: dict[str, int]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        begins = {p[:k] for p in pieces for k in range(1, len(p))}
        ids = {self._hash(p): 0 for p in begins} | {self._hash(p): i for p, i in pieces.items()}  # 0: no piece, but the beginning of one
        self.shift = np.uint64(64 - max(4, (8 * len(ids)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.ids, self.full = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, bool)
        self.more, onward = np.zeros(size, bool), {self._hash(p) for p in begins}
        for h, i in ids.items():
            at = h >> int(self.shift)
            while self.full[at]:
                at = (at + 1) % size
            self.keys[at], self.ids[at], self.full[at], self.more[at] = h, i, True, h in onward

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h ^ ord(c)) * _MIX) & (1 << 64) - 1
            h ^= h >> 29
        return h * _MIX & (1 << 64) - 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash in the table, or -1."""
        out, todo, at = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), hashes >> self.shift
        while len(todo):
            full = self.full[at]
            todo, at = todo[full], at[full]
            same = self.keys[at] == hashes[todo]
            out[todo[same]] = at[same]
            todo, at = todo[~same], (at[~same] + np.uint64(1)) % np.uint64(len(self.keys))
        return out

    def arcs(self, group: list[str], length: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For each span of a word of ``length`` signs: the words with a piece there, and the pieces."""
        signs = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(len(group), length).astype(np.uint64)
        mix, turn, found = np.uint64(_MIX), np.uint64(29), {}
        for a in range(length):
            live, state = np.arange(len(group)), np.zeros(len(group), np.uint64)
            for b in range(a + 1, min(length, a + self.longest) + 1):
                state = (state ^ signs[live, b - 1]) * mix
                state ^= state >> turn
                at = self._find(state * mix)
                ids = np.where(at >= 0, self.ids[at], 0)
                if b == a + 1:
                    found[a, b] = live, np.where(ids > 0, ids, 1)
                else:
                    hit = ids > 0
                    if hit.any():
                        found[a, b] = live[hit], ids[hit]
                on = (at >= 0) & self.more[at]
                live, state = live[on], state[on]
                if not len(live):
                    break
        return found

    def forward(self, arcs, length: int, size: int, prob: np.ndarray) -> np.ndarray:
        alpha = np.zeros((length + 1, size, prob.shape[1]))
        alpha[0] = 1
        for (a, b), (rows, ids) in sorted(arcs.items(), key=lambda x: x[0][1]):
            alpha[b, rows] += alpha[a, rows] * prob[ids]
        return alpha

    def logs(self, tokens: list[str], prob: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; ``prob`` has a row per piece, the first of zeros."""
        out = np.zeros((len(tokens), prob.shape[1]))
        for length, at, group in _by_length(tokens):
            out[at] = np.log(self.forward(self.arcs(group, length), length, len(group), prob)[length])
        return out

    def expected(self, tokens: list[str], weights: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; weights[i, l] is how often word i is in language l."""
        total = np.zeros_like(prob)
        for length, at, group in _by_length(tokens):
            arcs = self.arcs(group, length)
            alpha = self.forward(arcs, length, len(group), prob)
            beta = np.zeros_like(alpha)
            beta[length] = 1
            for (a, b), (rows, ids) in sorted(arcs.items(), key=lambda x: -x[0][0]):
                beta[a, rows] += beta[b, rows] * prob[ids]
            scale = weights[at] / alpha[length]
            for (a, b), (rows, ids) in arcs.items():
                np.add.at(total, ids, alpha[a, rows] * prob[ids] * beta[b, rows] * scale[rows])
        total[0] = 0
        return total


def _by_length(tokens: list[str], most: int = 20_000):
    marked = [_MARK + t for t in tokens]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        for k in range(0, len(at), most):
            part = at[k:k + most]
            yield length, part, [marked[i] for i in part]


def _normal(counts: np.ndarray, smooth: float) -> np.ndarray:
    prob = counts + smooth
    prob[0] = 0
    return prob / prob.sum(axis=0)


def train(docs: DataFrame, path: str, per_language: int = 2000, rounds: int = 4, smooth: float = 0.02) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, learned from ``doc_id, text, lang`` rows.

    At most ``per_language`` documents of each language are used, those with the smallest hash of
    their id: a bounded sample for the fit alone. Nothing else is bounded.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("of")).collect()  # one row per language
    # First a share of each language that holds somewhat more than the sample, by hash; then the exact smallest among those.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.coalesce(*(F.when(F.col("lang") == name, F.lit(int(min(1.0, (1.2 * per_language + 50) / of) * (1 << 30)))) for name, of in sizes), F.lit(0))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = known.select("doc_id", "lang", place.alias("place")).filter(F.col("place") < limit).withColumn("k", F.row_number().over(order))
    chosen = chosen.filter(F.col("k") <= per_language).select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang")).distinct()
    # At most ``per_language`` ids of each language.
    sample = known.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang"))).select("lang", "text")

    def split(step: pa.RecordBatch) -> pa.RecordBatch:
        lang, text = (step.column(k).to_pylist() for k in (0, 1))
        counts: dict[tuple[str, str], int] = {}
        for name, t in zip(lang, text, strict=True):
            for w in words(t):
                counts[name, w] = counts.get((name, w), 0) + 1
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                                           pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    counted, _ = store(arrow_step(sample, split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    names = sorted(r[0] for r in counted.select("lang").distinct().collect())  # one row per language
    pieces = load_pieces(path)
    prob = _normal(np.ones((len(pieces) + 2, len(names))), 0)
    column = {name: k for k, name in enumerate(names)}
    for _ in range(rounds if names else 0):
        prob = _normal(_expectations(counted, column, path, prob), smooth)
    return names, prob


def _expectations(counted: DataFrame, column: dict[str, int], path: str, prob: np.ndarray) -> np.ndarray:
    def run(batches):
        lattice, total = kept(f"lattice {path}", lambda: Lattice(load_pieces(path)), "language"), np.zeros_like(prob)
        for batch in batches:
            lang, tokens, n = (batch.column(k).to_pylist() for k in range(3))
            weights = np.zeros((len(tokens), prob.shape[1]))
            weights[np.arange(len(tokens)), [column[x] for x in lang]] = n
            total += lattice.expected(tokens, weights, prob)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    sums = np.zeros_like(prob)
    # At most one row for each piece of the vocabulary and language.
    for piece, lang, n in counted.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n")).collect():
        sums[piece, lang] = n
    return sums


def _told(texts: list[str | None], names: list[str], prob: np.ndarray, stamp: str, path: str):
    """Best language, score and number of words of each text."""
    lists = [words(t) for t in texts]
    tokens, at, sizes = code_tokens(lists)
    best, score = ["und"] * len(lists), np.zeros(len(lists))
    if names and len(at):
        held = kept("language memo", lambda: {"stamp": stamp, "memo": {}, "old": {}}, "language")
        if held["stamp"] != stamp:  # another model's
            held.update(stamp=stamp, memo={}, old={})
        memo, old = held["memo"], held["old"]
        for t in tokens:
            if t not in memo and t in old:
                memo[t] = old[t]
        new = [t for t in tokens if t not in memo]
        if new:
            lattice = kept(f"lattice {path}", lambda: Lattice(load_pieces(path)), "language")
            memo.update(zip(new, lattice.logs(new, prob), strict=True))
        logs = np.array([memo[t] for t in tokens])[at]
        if len(memo) > MEMO:  # what was not used lately is forgotten
            held.update(memo={}, old=memo)
        full = np.flatnonzero(sizes)
        sums = np.add.reduceat(logs, (np.cumsum(sizes) - sizes)[full], axis=0)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        score[full] = share
        for row, k in zip(full.tolist(), sums.argmax(axis=1).tolist(), strict=True):
            best[row] = names[k]
    return best, score, sizes


def predict(docs: DataFrame, names: list[str], prob: np.ndarray, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, n_words``, one row per input row.

    ``score`` is the share of the best language among all, each equally likely before the text is
    read. Rules for odd input: text that is null or has no letter is ``und`` with score 0, as is all
    text if no language was learned; of equally likely languages the first by name wins; null and
    repeated ids pass through; an empty table gives no rows.
    """
    model, stamp = docs.sparkSession.sparkContext.broadcast(prob), uuid.uuid4().hex  # pieces of the vocabulary times languages

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        best, score, sizes = _told(step.column(1).to_pylist(), names, model.value, stamp, path)
        return pa.RecordBatch.from_arrays([step.column(0), pa.array(best, pa.string()), pa.array(score), pa.array(sizes)], ["doc_id", "lang_pred", "score", "n_words"])

    return arrow_step(columns_of(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double, n_words long")


def accept(docs: DataFrame, names: list[str], prob: np.ndarray, path: str, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has letters and whose best language scores at least ``min_score``."""
    model, stamp = docs.sparkSession.sparkContext.broadcast(prob), uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        best, score, _ = _told(step.column(at).to_pylist(), names, model.value, stamp, path)
        return step.filter(pa.array([b != "und" and s >= min_score for b, s in zip(best, score.tolist(), strict=True)], pa.bool_()))

    return arrow_step(docs, run, docs.schema, text_col)


def identify(docs: DataFrame, path: str, hold_out: int = 2, folds: int = 4, **settings) -> DataFrame:
    """Learn from the documents outside the held-out fold and label all of them: ``doc_id, held_out, lang_pred, score, n_words``."""
    fold = remainder(F.col("doc_id"), folds)
    names, prob = learn(docs, path, hold_out, folds, **settings)
    return predict(docs, names, prob, path).withColumn("held_out", fold == hold_out)


def learn(docs: DataFrame, path: str, hold_out: int = 2, folds: int = 4, **settings) -> tuple[list[str], np.ndarray]:
    return train(docs.select("doc_id", "text", "lang").filter(remainder(F.col("doc_id"), folds) != hold_out), path, **settings)


@query("op2_language_id")
def op2_language_id(spark, folder):
    return identify(table(spark, folder, "documents"), vocabulary())

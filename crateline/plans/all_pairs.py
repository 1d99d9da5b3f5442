"""Best others and first twins of vectors without structure: blocks of rows against blocks of rows.

Where bounds would send a vector to many tiles, every row goes to a fixed number of block pairs instead,
so what is shuffled grows with the rows; only products grow with their square, in even tasks. A task works
through its two blocks in squares. Products are taken in single precision first; whatever comes within ``SLACK`` of
counting is priced again in doubles, pair by pair, so that equal vectors get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least number of blocks, and most rows of one; rows and columns of a square; pairs priced in doubles at once.
BLOCKS, ROWS, SQUARE, EXACT = 12, 65_536, (1_024, 2_048), 1 << 16
# More than single precision loses on unit vectors.
SLACK = 2e-5


def meet_all(queries: DataFrame, points: DataFrame, rows: int, match: Callable, schema: str) -> DataFrame:
    """``match`` for every block of queries and every block of points; both have an ``id``, there are ``rows`` points."""
    blocks = max(BLOCKS, -(-rows // ROWS))
    every, mine = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = queries.select("*", mine.alias("q_block"), every.alias("p_block"))
    own = points.select(*[F.col(c).alias(c) for c in points.columns])  # fresh columns for the self join
    right = own.select("*", mine.alias("p_block"), every.alias("q_block"))
    keys = ["q_block", "p_block"]
    left, right = (side.repartition(blocks * blocks, *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(match, schema)


def _units(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    exact = np.vstack(frame["unit"].to_numpy()).astype(np.float64)
    return exact, exact.astype(np.float32)


def _exact(a: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    told = np.empty(len(row))
    for at in range(0, len(row), EXACT):
        part = slice(at, at + EXACT)
        told[part] = np.einsum("ij,ij->i", a[row[part]], b[column[part]])
    return told


def best_others(k: int, counted=None) -> Callable:
    """Rows (id, other, cosine) of the ``k`` best others in a block, for queries with ``least``, which none of their k best is under."""
    def match(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"id": [], "other": [], "cosine": []})
        if counted is not None:
            counted.add(len(q) * len(p))
        p = p.sort_values("id")
        (u, u32), (v, v32) = _units(q), _units(p)
        ids, others = q["id"].to_numpy(), p["id"].to_numpy()
        least = q["least"].fillna(-np.inf).to_numpy(dtype=np.float64) - SLACK
        told = []
        for a in range(0, len(q), SQUARE[0]):
            mine, limit = slice(a, a + SQUARE[0]), least[a:a + SQUARE[0]].copy()
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for b in range(0, len(p), SQUARE[1]):
                found = _square(u[mine], u32[mine], v[b:b + SQUARE[1]], v32[b:b + SQUARE[1]], limit, k, ids[mine], others[b:b + SQUARE[1]])
                if not len(found[0]):
                    continue
                row, other, score = (np.concatenate(both) for both in zip(held, found, strict=True))
                order = np.lexsort((other, -score, row))
                row, other, score = row[order], other[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                last = place == k - 1
                limit[row[last]] = np.maximum(limit[row[last]], score[last])
                held = tuple(c[place < k] for c in (row, other, score))
            told.append(pd.DataFrame({"id": ids[mine][held[0]], "other": held[1], "cosine": held[2]}))
        return pd.concat(told, ignore_index=True)

    return match


def _square(u, u32, v, v32, limit, k, ids, others):
    """(row, other, score) of what may be among each row's k best."""
    scores = u32 @ v32.T
    floor = limit - SLACK
    many = np.flatnonzero((scores >= floor.astype(np.float32)[:, None]).sum(axis=1) > 4 * k) if scores.shape[1] > 4 * k else []
    if len(many):
        # The row itself may be among them.
        floor[many] = np.maximum(floor[many], np.partition(scores[many], -k - 1, axis=1)[:, -k - 1] - 2 * SLACK)
    row, column = np.nonzero(scores >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None])
    apart = ids[row] != others[column]
    row, column = row[apart], column[apart]
    score = _exact(u, v, row, column)
    good = score >= limit[row]
    return row[good], others[column[good]], score[good]


def first_twin(least: float) -> Callable:
    """Rows (id, earlier, cosine): for each query (id, grp, kind, last) the smallest ``first`` of a twin in a block."""
    never = np.iinfo(np.int64).max

    def match(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"id": [], "earlier": [], "cosine": []})
        p = p.sort_values("first")
        (u, u32), (v, v32) = _units(q), _units(p)
        first, last = p["first"].to_numpy(), q["last"].to_numpy()
        kinds = pd.factorize(pd.concat([q["kind"], p["kind"]], ignore_index=True))[0]  # unknown: -1
        facts = [(f["id"].to_numpy(), f["grp"].to_numpy(), kind) for f, kind in ((q, kinds[:len(q)]), (p, kinds[len(q):]))]
        best, cosine = np.full(len(q), never), np.zeros(len(q))
        for b in range(0, len(p), SQUARE[1]):
            theirs = slice(b, b + SQUARE[1])
            # Later columns are no earlier.
            open_ = np.flatnonzero(np.minimum(best, last) > first[b])
            if not len(open_):
                break
            for a in range(0, len(open_), SQUARE[0]):
                rows = open_[a:a + SQUARE[0]]
                row, column = np.nonzero(u32[rows] @ v32[theirs].T >= least - SLACK)
                row, column = rows[row], column + b
                (own, grp, kind), (other, its_grp, its_kind) = facts
                good = (own[row] != other[column]) & (grp[row] == its_grp[column]) & (first[column] < last[row])
                good &= (kind[row] < 0) | (kind[row] != its_kind[column])
                row, column = row[good], column[good]
                score = _exact(u, v, row, column)
                good = score >= least
                row, column, score = row[good], column[good], score[good]
                order = np.lexsort((score, first[column], row))
                row, column, score = row[order], column[order], score[order]
                lead = np.flatnonzero(np.diff(row, prepend=-1))
                row, at, score = row[lead], first[column[lead]], score[lead]
                better = (at < best[row]) | ((at == best[row]) & (score < cosine[row]))
                best[row[better]], cosine[row[better]] = at[better], score[better]
        met = best < never
        return pd.DataFrame({"id": facts[0][0][met], "earlier": best[met], "cosine": cosine[met]})

    return match

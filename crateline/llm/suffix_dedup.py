"""Suffix-array dedup of repeated byte strings by a distributed difference-cover algorithm.

A byte goes if a string of ``SPAN`` bytes that covers it also starts elsewhere. The suffix array
is built over those parts of the texts that can hold such a start and are not settled already:

1. Every window of ``SPAN`` bytes has an anchor, the leftmost least hash among the words at which its
   64-byte strings start. Equal windows have equal anchors, so windows whose anchor's 64 bytes occur
   once are not repeated.
2. The rest is cut into cells: windows of one anchor whose distances to it differ by less than ``STEP``.
   All windows of a cell share an inner string of ``SPAN - STEP + 1`` bytes; if that occurs once, none
   is repeated. They lie in an outer string; if that occurs again, all are. What is left are the ends
   of repeats; with them go, once for each different outer string, the cells of equal inner string.
3. Suffixes are sorted over these. Characters are blocks of 40 bytes, ordered by fingerprint, so a
   suffix's first five characters are its first ``SPAN`` bytes, and suffixes 40 bytes apart are
   neighbours in one string. Suffixes at positions 1 and 2 modulo 3 are sampled: their triples are
   sorted and named by rank, and the names recursed on; two names, six characters, cover the
   ``SPAN`` bytes, so the recursion ends there. The remaining suffixes, at 0 modulo 3, are sorted by
   character and rank of the next suffix and merged with the sample by the rules of the difference
   cover. Adjacent suffixes with equal ``SPAN``-byte prefixes are repeats.

Sorts are exchanges of packed messages between chunks of documents and ranges of keys (see
``exchange``); a chunk names a key once, so no passage makes a range crowded.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, discard, distinct, mixed, steps, store, table
from .exchange import MESSAGE, answer, ask, gather, joined, packed, rows, slices, unpacked
from .registry import query

SPAN, WORD, BLOCK, ANCHOR = 200, 8, 40, 64
REACH = SPAN - ANCHOR
#: Distances of one cell; places whose hashes are compared together.
STEP, PIECE = 16, 1 << 16
_M = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
_CHUNK = "chunk long, n_bytes long, docs binary, sizes binary, text binary, anchors binary"
_KEPT = "doc_id long, n_bytes long, starts binary, ends binary, kept binary"


def words_at(data: np.ndarray) -> np.ndarray:
    """Hash of the 8 bytes at every place."""
    n = max(0, len(data) - WORD + 1)
    return mixed(np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()) if n else np.zeros(0, np.uint64)


def _joined(left: np.ndarray, right: np.ndarray, apart: int) -> np.ndarray:
    n = max(0, min(len(left), len(right) - apart))
    return left[:n] * _M + right[apart:apart + n]


def blocks_at(data: np.ndarray) -> np.ndarray:
    """Characters: a non-zero fingerprint of the 40 bytes at every place."""
    word = words_at(data)
    pair = _joined(word, word, WORD)
    four = _joined(pair, pair, 2 * WORD)
    return np.maximum(mixed(_joined(four, word, 4 * WORD)), np.uint64(1))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every place, as a view."""
    return np.ndarray((max(0, len(data) - WORD + 1),), "<u8", np.ascontiguousarray(data), 0, (1,))


def anchors_at(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of strings that stand one behind the other: the first window of each, the anchor's place, and how many windows have it."""
    ends = np.cumsum(sizes)
    begin, end = (ends - sizes)[sizes >= SPAN], (ends - SPAN + 1)[sizes >= SPAN]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3
    first, place = [], []
    for at in range(0, len(text) - SPAN + 1, PIECE):
        least, width = _words(text[at:at + PIECE + SPAN - 1])[:-(ANCHOR - WORD)] * _M, 1
        least = (least & ~_PLACE) | np.arange(len(least), dtype=np.uint64)
        while 2 * width <= REACH + 1:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if rest := REACH + 1 - width:
            least = np.minimum(least[:-rest], least[rest:])
        new = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        first.append(at + new)
        place.append(at + (least[new] & _PLACE).astype(np.int64))
    first, place = np.concatenate(first), np.concatenate(place)
    # A run goes on over the edge of a piece, and ends with its string; windows across strings are none.
    changed = np.concatenate([[True], place[1:] != place[:-1]])
    first, place = first[changed], place[changed]
    edges = distinct(np.concatenate([first, begin, end]))
    place = place[np.searchsorted(first, edges, side="right") - 1]
    string = np.searchsorted(begin, edges, side="right") - 1
    inside = (string >= 0) & (edges < end[string])
    windows = np.diff(np.concatenate([edges, [len(text) - SPAN + 1]]))
    return edges[inside], place[inside], windows[inside]


def _anchor_keys(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """40 bits of the hashes of anchors' 64 bytes; they only tell what occurs once."""
    word, key = _words(text), np.zeros(len(place), np.uint64)
    for k in range(0, ANCHOR, WORD):
        key = mixed(key ^ word[place + k])
    return key & ~_PLACE


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the 0, 1, 2, ..., modulo 2 to the 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Strings:
    """Fingerprints of any strings of a text of at least 8 bytes each, by sums over the words in front of every place."""

    def __init__(self, text: np.ndarray):
        word = words_at(text)
        self.before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * _powers(int(_M), len(word)), dtype=np.uint64)])
        self.back = _powers(pow(int(_M), -1, 1 << 64), len(word))

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.before[end - WORD + 1] - self.before[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def _chunks(docs: DataFrame) -> DataFrame:
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for step in steps(batches):
            ids, texts = step.columns
            data = [(t or "").encode() for t in texts.to_pylist()]
            missing = np.asarray(ids.is_null()).view(np.uint8)
            text, sizes = np.frombuffer(b"".join(data), np.uint8), np.array([len(x) for x in data], np.int64)
            yield rows([((part << 32) + number, len(text), packed(np.asarray(ids.fill_null(0)), missing),
                         packed(sizes), packed(text), _runs_packed(*anchors_at(text, sizes)))], _CHUNK)
            number += 1
    return docs.mapInArrow(run, _CHUNK)


def _runs_packed(first: np.ndarray, place: np.ndarray, windows: np.ndarray) -> bytes:
    return packed(np.diff(first, prepend=0), (place - first).astype(np.uint8), windows.astype(np.uint8))


def _runs_unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step, ahead, windows = unpacked(data)
    first = np.cumsum(step)
    return first, first + ahead, windows.astype(np.int64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(keys, return_counts=True)
    return found, n.astype(np.uint32)


def _flat(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _totals(messages):
    """For each chunk's keys: whether a key occurs twice in all."""
    keys, counts = (np.concatenate(c) for c in zip(*messages, strict=True))
    _, at = np.unique(keys, return_inverse=True)
    twice = (np.bincount(at, counts) > 1)[at].astype(np.uint8)
    return [(x,) for x in np.split(twice, np.cumsum([len(m[0]) for m in messages])[:-1])]


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``at[i] ... at[i] + n[i] - 1`` for all i in turn."""
    ends = np.cumsum(n)
    return np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among ascending keys."""
    at = np.searchsorted(keys, values)
    return keys[np.minimum(at, len(keys) - 1)] == values if len(keys) else np.zeros(len(values), bool)


def _anchor_question(row):
    """The anchors of all documents of a chunk."""
    return _counted(_anchor_keys(unpacked(row["text"])[0], _runs_unpacked(row["anchors"])[1]))


_BODY = "chunk long, homes binary, sizes binary, text binary"


def _strings_of(first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending runs of windows as strings: begin and size of each run of adjacent ones, and the string of each."""
    new = np.concatenate([[True], first[1:] != (first + windows)[:-1]])
    string = np.cumsum(new) - 1
    return first[new], np.bincount(string, windows).astype(np.int64) + SPAN - 1, string


def _regions(chunk, held):
    """Runs of windows whose anchor occurs again; ``homes``: the first byte of each in its chunk."""
    row = next(r for r in held if r["kind"] == "chunk")
    told = [r for r in held if r["kind"] == "told"]
    if not told:
        return []
    (text,), (first, place, windows) = unpacked(row["text"]), _runs_unpacked(row["anchors"])
    key = _anchor_keys(text, place)
    again = _among(key, _counted(key)[0][joined(told)[0] == 1])
    if not again.any():
        return []
    first, place, windows = first[again], place[again], windows[again]
    begin, size, string = _strings_of(first, windows)
    moved = (np.cumsum(size) - size - begin)[string]
    return [(chunk, packed(begin), packed(size), packed(text[_ranges(begin, size)]), _runs_packed(first + moved, place + moved, windows))]


def _cells(row: dict):
    """The cells of a body of regions: first window and number of windows, hash of the inner string, fingerprint of the outer one."""
    (text,), (first, place, windows) = unpacked(row["text"]), _runs_unpacked(row["anchors"])
    most, least = place - first, place - first - windows + 1
    n = most // STEP - least // STEP + 1
    run = np.repeat(np.arange(len(first)), n)
    cell = (most // STEP)[run] - _ranges(np.zeros(len(n), np.int64), n)
    ahead = np.minimum(most[run], STEP * cell + STEP - 1)
    begin, count = place[run] - ahead, ahead - np.maximum(least[run], STEP * cell) + 1
    strings, inner = Strings(text), place[run] - STEP * cell
    return text, begin, count, strings.at(inner, inner + SPAN - STEP + 1) & ~_PLACE, strings.at(begin, begin + count - 1 + SPAN)


def _cell_question(row):
    inner, outer, at = _distinct(*_cells(row)[-2:])
    return inner, outer, np.bincount(at).astype(np.uint32)


ONCE, SETTLED, OPEN, WITNESS = 0, 1, 2, 3


def _classes(messages):
    """For each chunk's cells: not repeated, repeated as a whole, to be sorted, or repeated and to be sorted as one cell of its outer string."""
    inner, outer, n = (np.concatenate(c) for c in zip(*messages, strict=True))
    group = np.unique(inner, return_inverse=True)[1]
    string = _distinct(inner, outer)[-1]
    again, whole = np.bincount(group, n)[group] > 1, np.bincount(string, n)[string] > 1
    still = again & ~whole
    first = np.zeros(len(string), bool)
    first[np.unique(string, return_index=True)[1]] = True
    witness = whole & first & (np.bincount(group, still)[group] > 0)
    told = np.where(witness, WITNESS, np.where(whole, SETTLED, np.where(still, OPEN, ONCE))).astype(np.uint8)
    return [(x,) for x in np.split(told, np.cumsum([len(m[0]) for m in messages])[:-1])]


def _cores(chunk, held):
    """The windows to sort, as strings; and the bytes that are covered already, as intervals of the chunk."""
    row = next(r for r in held if r["kind"] == "body")
    text, first, windows, inner, outer = _cells(row)
    at = _distinct(inner, outer)[-1]
    told = joined([r for r in held if r["kind"] == "told"])[0][at]
    one = np.zeros(len(at), bool)
    one[np.unique(at, return_index=True)[1]] = True
    (homes,), (sizes,) = unpacked(row["homes"]), unpacked(row["sizes"])
    starts = np.cumsum(sizes) - sizes
    home = lambda place: place + (homes - starts)[np.searchsorted(starts, place, side="right") - 1]

    whole = (told == SETTLED) | (told == WITNESS)
    begin, end = first[whole], (first + windows - 1 + SPAN)[whole]
    new, last = np.ones(len(begin), bool), np.ones(len(begin), bool)
    new[1:] = last[:-1] = begin[1:] >= end[:-1]  # strings of regions end where the next begin
    gone = packed(home(begin[new]), home(begin[new]) + end[last] - begin[new])
    sort = (told == OPEN) | ((told == WITNESS) & one)
    begin, size, _ = _strings_of(first[sort], windows[sort]) if sort.any() else (np.zeros(0, np.int64),) * 3
    return [(chunk, packed(home(begin)), packed(size), packed(text[_ranges(begin, size)]), gone)]


class _Suffixes:
    """The strings of a chunk as suffixes: characters at every place, sampled suffixes, names and ranks."""

    def __init__(self, row):
        (sizes,), (text,) = unpacked(row["sizes"]), unpacked(row["text"])
        # Behind a string's last character stands the next string.
        n = sizes - BLOCK + 1
        place = _ranges(np.zeros(len(n), np.int64), n)
        self.char = blocks_at(text)[_ranges(np.cumsum(sizes) - sizes, n)]
        self.end = np.repeat(np.cumsum(n), n)
        self.kind = place // BLOCK % 3
        # Windows: the suffixes that hold SPAN bytes of their string. Others are wanted a number of characters behind a window.
        windows = np.repeat(sizes - SPAN + 1, n)
        self.window = np.flatnonzero(place < windows)
        self.sample = np.flatnonzero((self.kind != 0) & (place % BLOCK < windows))
        self.span = self.char[self.window]
        for k in range(1, SPAN // BLOCK):
            self.span = mixed(self.span * _M + self.char[self.window + k * BLOCK])

    def ahead(self, values: np.ndarray, at: np.ndarray, blocks: int) -> np.ndarray:
        """Values so many characters after ``at``; 0 behind a string's end."""
        to = at + blocks * BLOCK
        inside = to < self.end[at]
        return np.where(inside, values[np.where(inside, to, 0)], 0) if len(values) else np.zeros(len(at), np.uint64)

    def triples(self):
        """Distinct triples of characters of the sample in order, and which each sampled suffix has."""
        return _distinct(*(self.ahead(self.char, self.sample, k) for k in range(3)))

    def pairs(self, name: np.ndarray):
        """Distinct pairs of names: a sampled suffix's and that of the one three characters on."""
        full = np.zeros(len(self.char), np.uint64)
        full[self.sample] = name
        return _distinct(name, self.ahead(full, self.sample, 3))

    def records(self, rank: np.ndarray):
        """Distinct records of the windows: character, next, kind, own rank, ranks one and two characters on, fingerprint; how often each; which each window has."""
        full = np.zeros(len(self.char), np.uint64)
        full[self.sample] = rank
        w = self.window
        columns = (self.char[w], self.ahead(self.char, w, 1), self.kind[w].astype(np.uint64), full[w], self.ahead(full, w, 1), self.ahead(full, w, 2), self.span)
        order = _distinct(*columns)
        return (*order[:-1], np.bincount(order[-1], minlength=len(order[0])).astype(np.uint32), order[-1])


def _distinct(*columns: np.ndarray):
    """Distinct rows in lexicographic order, and the place of each row among them."""
    order = np.lexsort(columns[::-1])
    if not len(order):
        return (*columns, order)
    sorted_columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return (*(c[new] for c in sorted_columns), at)


def _named(messages):
    """For each chunk's keys: their rank among the distinct keys of the range, from 0."""
    columns = [np.concatenate(c) for c in zip(*messages, strict=True)]
    rank = _distinct(*columns)[-1]
    return [(x,) for x in np.split(rank, np.cumsum([len(m[0]) for m in messages])[:-1])]


def _bases(answers: DataFrame) -> tuple[dict[int, int], int]:
    """How many names come before each range, and how many there are; one row per range."""
    def run(batches):
        for batch in batches:
            yield rows([(b, int(unpacked(d)[0].max()) + 1) for b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], "bucket int, n long")
    most = dict(answers.select("bucket", "data").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.max("n")).collect())
    base, total = {}, 0
    for bucket in sorted(most):
        base[bucket], total = total, total + most[bucket]
    return base, total


def _names(held: list[dict], base: dict[int, int]) -> np.ndarray:
    """A chunk's names over all ranges, from 1."""
    parts = sorted(held, key=lambda r: r["bucket"])
    return _flat([unpacked(r["data"])[0].astype(np.uint64) + np.uint64(base[r["bucket"]] + 1) for r in parts])


def _merged(messages):
    """Merge the suffixes of a range and tell each chunk which of its records are repeated.

    Ranks know six characters and more, of which five decide. So that ties behind the fifth cannot
    contradict each other, suffixes of one prefix stand in the merge as one, in the first class that has it.
    """
    char, second, kind, own, one, two, span, times = (np.concatenate(c) for c in zip(*messages, strict=True))
    prefix = _distinct(char, span)[-1]
    by_class = np.lexsort((kind, prefix))
    stands = by_class[np.concatenate([[True], np.diff(prefix[by_class]) > 0])]
    rest, sample = stands[kind[stands] == 0], stands[kind[stands] != 0]
    # The sample is in order by rank within a character; the rest by character and the rank of the next suffix.
    sample = sample[np.lexsort((own[sample], char[sample]))]
    rest = rest[np.lexsort((one[rest], char[rest]))]
    after, place = np.arange(len(rest)), np.arange(len(sample))
    for k, keys in ((1, (char, one)), (2, (char, second, two))):
        against = kind[sample] == k
        at = _distinct(*(np.concatenate([c[rest], c[sample[against]]]) for c in keys))[-1]
        mine, other = at[:len(rest)], at[len(rest):]
        after += np.searchsorted(other, mine)
        place[against] += np.searchsorted(mine, other)
    position = np.empty(len(stands), np.int64)
    position[prefix[rest]], position[prefix[sample]] = after, place
    order = np.argsort(position[prefix], kind="stable")
    same = (char[order][1:] == char[order][:-1]) & (span[order][1:] == span[order][:-1])
    twice = times[order] > 1
    twice[1:] |= same
    twice[:-1] |= same
    told = np.zeros(len(char), np.uint8)
    told[order] = twice
    return [(x,) for x in np.split(told, np.cumsum([len(m[0]) for m in messages])[:-1])]


def _mark(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("kind", F.lit(kind))


def _union(*parts: DataFrame) -> DataFrame:
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part, allowMissingColumns=True)
    return made


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without its repeated bytes: ``doc_id, n_bytes, starts, ends, kept``.

    ``starts`` and ``ends`` are the maximal removed runs as packed 64-bit integers, ``kept`` the
    remaining UTF-8 bytes (a cut may fall inside a character). Rules for odd input: null text is
    empty; repeated rows and ids are documents of their own, so the bytes of copies of at least
    ``SPAN`` bytes all go; an empty table gives no rows.
    """
    spark = docs.sparkSession
    chunks, _ = store(_chunks(columns_of(docs, id_col, text_col)), "texts")
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (64 << 20))

    told, told_path = store(answer(ask(chunks, _anchor_question, buckets), _totals, buckets), "anchors")
    regions, regions_path = store(gather(_union(_mark(chunks, "chunk"), _mark(told, "told")), "chunk", _regions, f"{_BODY}, anchors binary"), "regions")
    discard(spark, told_path)
    told, told_path = store(answer(ask(regions, _cell_question, buckets), _classes, buckets), "cells")
    cores, _ = store(gather(_union(_mark(regions, "body"), _mark(told, "told")), "chunk", _cores, f"{_BODY}, gone binary"), "cores")
    discard(spark, regions_path, told_path)
    flags = _suffix_array(cores, buckets)

    final = _union(_mark(chunks.drop("anchors"), "chunk"), _mark(cores.select("chunk", F.col("sizes").alias("core_sizes"), "homes", "gone"), "cores"), _mark(flags, "flags"))
    return gather(final, "chunk", lambda chunk, held: _kept(held), _KEPT)


def _suffix_array(cores: DataFrame, buckets: int) -> DataFrame:
    """For each chunk the windows of its cores that are repeated, as ``bucket, chunk, data``."""
    names, names_path = store(answer(ask(cores, lambda row: _Suffixes(row).triples()[:-1], buckets), _named, buckets), "names")
    base, total = _bases(names)
    shift = np.uint64(64 - max(1, total.bit_length()))

    def names_of(held):
        suffixes = _Suffixes(next(r for r in held if r["kind"] == "body"))
        told = [r for r in held if r["kind"] == "names"]
        return suffixes, _names(told, base)[suffixes.triples()[-1]] if told else np.zeros(0, np.uint64)

    def pairs(chunk, held):
        suffixes, name = names_of(held)
        first, second, _ = suffixes.pairs(name)
        return [(bucket, chunk, packed(first[a:b], second[a:b])) for bucket, a, b in slices(first << shift, buckets)]

    named = _union(_mark(cores, "body"), _mark(names, "names"))
    ranks, ranks_path = store(answer(gather(named, "chunk", pairs, MESSAGE), _named, buckets), "ranks")
    rank_base, _ = _bases(ranks)

    def records(chunk, held):
        suffixes, name = names_of(held)
        told = [r for r in held if r["kind"] == "ranks"]
        rank = _names(told, rank_base)[suffixes.pairs(name)[-1]] if told else np.zeros(0, np.uint64)
        *columns, at = suffixes.records(rank)
        own = [(-1, chunk, packed(at))]
        return own + [(bucket, chunk, packed(*(c[a:b] for c in columns))) for bucket, a, b in slices(columns[0], buckets)]

    sent, _ = store(gather(_union(named, _mark(ranks, "ranks")), "chunk", records, MESSAGE), "suffixes")
    discard(cores.sparkSession, names_path, ranks_path)
    told = answer(sent.filter("bucket >= 0"), _merged, buckets)
    return told.unionByName(sent.filter("bucket < 0"))


def _kept(held):
    row = next(r for r in held if r["kind"] == "chunk")
    (ids, missing), (sizes,), (text,) = unpacked(row["docs"]), unpacked(row["sizes"]), unpacked(row["text"])
    step = np.zeros(len(text) + 1, np.int32)
    for core in (r for r in held if r["kind"] == "cores"):
        gone, until = unpacked(core["gone"])
        own = next((unpacked(r["data"])[0] for r in held if r["kind"] == "flags" and r["bucket"] < 0), np.zeros(0, np.int64))
        told = [r for r in held if r["kind"] == "flags" and r["bucket"] >= 0]
        (homes,), (core_sizes,) = unpacked(core["homes"]), unpacked(core["core_sizes"])
        windows = _ranges(homes, core_sizes - SPAN + 1)
        twice = windows[joined(told)[0][own] == 1] if told else windows[:0]
        for at, by in ((gone, 1), (until, -1), (twice, 1), (twice + SPAN, -1)):
            np.add.at(step, at, by)
    lost = np.cumsum(step[:-1]) > 0
    ends = np.cumsum(sizes)
    # Runs of documents that follow each other are runs of their own.
    new = np.concatenate([[True], lost[1:] != lost[:-1]]) if len(lost) else lost
    new[(ends - sizes)[sizes > 0]] = True
    edges = np.flatnonzero(new)
    starts, until = edges[lost[edges]], np.concatenate([edges, [len(lost)]])[1:][lost[edges]]
    kept = text[~lost].tobytes()
    upto = np.concatenate([[0], np.cumsum(~lost)])
    cuts, marks, out = upto[np.concatenate([[0], ends])].tolist(), np.searchsorted(starts, np.concatenate([[0], ends])).tolist(), []
    for doc, (i, m, size) in enumerate(zip(ids.tolist(), missing.tolist(), sizes.tolist(), strict=True)):
        own, at = slice(marks[doc], marks[doc + 1]), int(ends[doc]) - size
        out.append((None if m else i, size, (starts[own] - at).tobytes(), (until[own] - at).tobytes(), kept[cuts[doc]:cuts[doc + 1]]))
    return out


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, folder):
    found = repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        (F.octet_length("starts") / 8).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

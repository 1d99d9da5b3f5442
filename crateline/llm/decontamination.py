"""Benchmark decontamination by template canonicalisation.

A text becomes a template: words are lower-cased, numbers, names and units become typed
placeholders whose values are kept beside it. Windows of the templates of documents and benchmark
items are joined by hash; along one alignment, the values of equal placeholders must map to each
other without contradiction. So a question asked again with other numbers or names is found, and
text that merely has the same shape is not.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_step, code_tokens, columns_of, hash_tokens, let_go, mixed, store, table
from .registry import query

_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?\n]")
#: Words that are units where a number stands before them.
UNITS = frozenset(("mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams lb lbs pound pounds oz ounce ounces ton tons l ml liter liters "
                   "litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars "
                   "cent cents euro euros usd eur percent degree degrees mph kmh w kw v hz mb gb tb").split())
_NUMBER, _NAME, _UNIT, _END = 1, 2, 3, 4
#: Bits of the fixed filter through which a document's windows pass before they are shuffled.
FILTER_BITS = 24
_WINDOW = "key long, size int, way int, pos int, n_windows int, need int, heavy boolean, inside int, slots array<string>"
#: Ways to search a window: its tokens as they stand, lower-cased, or its template, where capitals at a sentence's start are names as the text has it, always or never.
_RAW, _TEXT, _NAMES, _WORDS = range(4)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MARKS = hash_tokens([b"", b"<number>", b"<name>", b"<unit>"], 1)


class Scan:
    """The tokens of some texts as one run of columns: raw codes, types, and the heads of name runs, which are the template's tokens."""

    def __init__(self, texts: list[str | None]):
        lists = [_TOKEN.findall(t) if t else [] for t in texts]
        self.tokens, at, sizes = code_tokens(lists)
        kind = np.array([_END if t in ".!?\n" else _NUMBER if t[0].isdigit() else _NAME if t[0].isupper() and not t[1:].isupper() else 0 for t in self.tokens], np.int8)
        lower = [t.lower() for t in self.tokens]
        unit = np.array([t in UNITS for t in lower], bool)
        codes = hash_tokens([t.encode() for t in lower])
        row, k = np.repeat(np.arange(len(texts)), sizes), kind[at]
        before = np.concatenate([[_END], k[:-1]])[:len(k)]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = _END
        solid = k != _END
        self.at, self.row, k, before = at[solid], row[solid], k[solid], before[solid]
        self.code = codes[self.at]
        # A capital at a sentence's start may be a name: if the text has it inside a sentence too, always, or never.
        start, place = (k == _NAME) & (before == _END), self.row * len(self.tokens) + self.at
        kind = np.where(unit[self.at] & (before == _NUMBER), _UNIT, k)
        never, text = np.where(start, 0, kind), np.where(start & ~np.isin(place, place[(k == _NAME) & ~start]), 0, kind)
        self.kinds = {_TEXT: text, _NAMES: kind, _WORDS: never}
        # What a window's first token is must not depend on what stands before it.
        self.firsts = {_TEXT: text, _NAMES: k, _WORDS: np.where(k == _NAME, 0, k)}
        head = ~((k == _NAME) & (before == _NAME))
        self.head, self.run = np.flatnonzero(head), np.cumsum(head) - 1
        count = lambda rows: np.bincount(rows, minlength=len(texts))
        self.n_raw, self.n_template = count(self.row), count(self.row[self.head])
        self.first_raw, self.first_run = np.cumsum(self.n_raw) - self.n_raw, np.cumsum(self.n_template) - self.n_template

    def raw(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``size`` tokens as they stand, and which are placeholders by more than half."""
        key, whole = _rolled(self.code, self.row, size)
        return whole, key[whole], 2 * _held(self.kinds[_TEXT] > 0, size)[whole] > size

    def template(self, size: int, way: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``size`` template tokens, and which have at least half of their tokens in words.

        They start at each head of a run, or at ``every`` token, also inside a run of names that what stands before a passage may have lengthened.
        """
        kind, first = self.kinds[way][self.head], self.firsts[way]
        rest, n = _codes(kind, self.code[self.head]), max(0, len(self.head) - size + 1)
        key, held = np.zeros(n, np.uint64), np.concatenate([[0], np.cumsum(kind > 0)])
        for k in range(1, size):
            key = key * _STEP + rest[k:k + n]
        start = np.arange(len(self.run)) if every and way != _TEXT else self.head
        start = start[self.run[start] < n]
        run = self.run[start]
        start = start[self.row[self.head[run + size - 1]] == self.row[start]]
        run = self.run[start]
        top = np.uint64(size + (way << 32)) * _STEP + _codes(first[start], self.code[start])
        return start, mixed(top * np.uint64(pow(int(_STEP), size - 1, 1 << 64)) + key[run]), 2 * ((first[start] > 0) + held[run + size] - held[run + 1]) <= size

    def slots(self, start: int, size: int, way: int) -> list[str]:
        run = self.run[start]
        own = self.head[run + 1:run + size]
        own = own[self.kinds[way][own] > 0].tolist()
        return [self.tokens[self.at[i]] for i in ([start, *own] if self.firsts[way][start] > 0 else own)]


def _codes(kind: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.where(kind > 0, _MARKS[np.minimum(kind, 3)], code)


def _rolled(code: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every ``size`` neighbours, and the starts of those within one text."""
    n = max(0, len(code) - size + 1)
    key = np.full(n, size + (_RAW << 32), np.uint64)
    for k in range(size):
        key = key * _STEP + code[k:k + n]
    return mixed(key), np.flatnonzero(row[:n] == row[size - 1:size - 1 + n])


def _held(slot: np.ndarray, size: int) -> np.ndarray:
    held = np.concatenate([[0], np.cumsum(slot)])
    return held[size:] - held[:-size]


def _windows_of(rows: DataFrame, fn) -> DataFrame:
    """Rows of windows that ``fn`` finds in the scan of a step's texts: row, then the columns of ``_WINDOW``."""
    names = ["id", *(x.split()[0] for x in _WINDOW.split(", "))]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.string())]

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        let_go("decontamination")
        ids, texts = step.columns
        found = list(fn(Scan(texts.to_pylist())))
        row, *columns = zip(*found, strict=True) if found else ([],) * 10
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names)

    return arrow_step(rows, run, f"id long, {_WINDOW}")


def _of_items(size: int, min_windows: int, min_tokens: int):
    """The windows of items: all raw ones, and the template's usable ones where they can decide."""
    def run(scan: Scan):
        for n in range(1, size + 1):
            start, key, heavy = scan.raw(n)
            some = np.flatnonzero(_own(scan.n_raw, n, size)[scan.row[start]])
            for p, x, h in zip(start[some].tolist(), key[some].astype(np.int64).tolist(), heavy[some].tolist(), strict=True):
                row = int(scan.row[p])
                of = int(scan.n_raw[row]) - n + 1
                yield row, x, n, _RAW, p - int(scan.first_raw[row]), of, min(min_windows, of), h, 0, []
            if n < min_tokens:
                continue
            for way in (_TEXT, _NAMES, _WORDS):
                start, key, good = scan.template(n, way)
                usable = np.bincount(scan.row[start[good]], minlength=len(scan.n_raw))
                good &= _own(scan.n_template, n, size)[scan.row[start]]
                for p, x in zip(start[good].tolist(), key[good].astype(np.int64).tolist(), strict=True):
                    row = int(scan.row[p])
                    of, can = int(scan.n_template[row]) - n + 1, int(usable[row])
                    need = min(min_windows, of)
                    if can >= need or 2 * can >= of:
                        yield row, x, n, way, int(scan.run[p] - scan.first_run[row]), of, min(need, can), False, 0, scan.slots(p, n, way)

    return run


def _own(n: np.ndarray, size: int, largest: int) -> np.ndarray:
    """Texts of ``n`` tokens whose windows have ``size`` of them."""
    return np.minimum(n, largest) == size


def _of_documents(sizes: list[tuple[int, int]], largest: int, passes: np.ndarray):
    """The windows of documents that pass the filter; short ones, which are whole items, once a text."""
    def run(scan: Scan):
        for way, n in sizes:
            start, key, good = scan.raw(n) if way == _RAW else scan.template(n, way, every=True)
            if way == _RAW:
                good = np.ones(len(key), bool)
            top = key >> np.uint64(64 - FILTER_BITS)
            good &= passes[top >> np.uint64(6)] >> (top & np.uint64(63)) & np.uint64(1) == 1
            start, key = start[good], key[good].astype(np.int64)
            row = scan.row[start]
            if way == _RAW and n < largest:
                _, one = np.unique(np.stack([row, key]), axis=1, return_index=True)
                start, key, row = start[one], key[one], row[one]
            run = scan.run[start]
            pos, inside = (start - scan.first_raw[row], np.zeros(len(row), int)) if way == _RAW else (run - scan.first_run[row], start - scan.head[run])
            for r, x, p, q, i in zip(row.tolist(), key.tolist(), start.tolist(), pos.tolist(), inside.tolist(), strict=True):
                yield r, x, n, way, q, 0, 0, False, i, [] if way == _RAW else scan.slots(p, n, way)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 8, min_windows: int = 3, min_tokens: int = 5, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of documents and the benchmark items they hold: ``doc_id, item_id, n_windows, coverage, same_values, contaminated``.

    Windows are read in three ways, in which capitals at a sentence's start are names if the text has them
    inside a sentence too, always, or never. In the latter two a window depends on its own tokens only, so
    that equal passages have equal windows whatever stands around them; one way must make the find.
    A document holds an item if at least ``min_windows`` windows (all, if the item has fewer) of
    ``size`` template tokens agree along one alignment with consistent slots. Windows of which more
    than half are placeholders fit any text of their shape, so they count only where the same
    lower-cased tokens stand: as many such windows of ``size`` raw tokens make a find too, and so
    does the whole item as it stands, however short. Where fewer than ``min_windows`` windows of an item's
    template are usable, these suffice if they are at least half of its windows; else only the raw tokens can tell.
    ``coverage`` is the share of the item's windows found; ``same_values`` tells a verbatim copy from a
    re-parameterised one. Rules for odd input: items with fewer than ``size`` tokens are one window,
    those with fewer than ``min_tokens`` template tokens are found verbatim only; texts without a token hold
    nothing and are held by nothing; rows that repeat an id count as one document or item; null ids
    are one id; an empty table on either side gives no rows.
    """
    items = _windows_of(columns_of(benchmark, item_col, item_text_col), _of_items(size, min_windows, min_tokens))
    items, _ = store(items.withColumnsRenamed({"id": "item_id", "pos": "item_pos", "slots": "item_slots"}).distinct(), "benchmark-windows")
    # A filter of fixed size: one bit for each leading value of a window's hash, at most 2 ** (FILTER_BITS - 6) rows.
    top = f"shiftrightunsigned(key, {64 - FILTER_BITS})"
    bits = items.groupBy(F.expr(f"shiftright({top}, 6)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({top} % 64 AS int)))").alias("bits"))
    passes = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for at, value in bits.collect():
        passes[at] = value & (2**64 - 1)
    sizes = sorted(map(tuple, items.select("way", "size").distinct().collect()))  # at most ``size`` of them for each way
    found = _windows_of(columns_of(docs, id_col, text_col), _of_documents(sizes, size, passes)).select(
        F.col("id").alias("doc_id"), "key", "inside", F.col("pos").alias("doc_pos"), F.col("slots").alias("doc_slots"))
    met = found.join(items.drop("size", "inside"), "key").filter(F.size("doc_slots") == F.size("item_slots"))
    pairs = F.transform(F.arrays_zip("item_slots", "doc_slots"), lambda z: F.struct(z["item_slots"].alias("a"), z["doc_slots"].alias("b")))
    # Of the starts inside one run of names, the one that has the item's first name, or else the run's head.
    best = F.struct(F.coalesce(F.get("item_slots", F.lit(0)) != F.get("doc_slots", F.lit(0)), F.lit(False)), F.col("inside"))
    met = met.groupBy("doc_id", "item_id", "way", (F.col("doc_pos") - F.col("item_pos")).alias("shift"), "item_pos").agg(
        F.max("heavy").alias("heavy"), F.max("n_windows").alias("n_windows"), F.max("need").alias("need"), F.min_by(pairs, best).alias("pairs"))
    lines = met.groupBy("doc_id", "item_id", "way", "shift").agg(
        F.countDistinct("item_pos").alias("n_windows"), F.countDistinct(F.when(F.col("heavy"), F.col("item_pos"))).alias("n_heavy"), F.max("n_windows").alias("of"),
        F.max("need").alias("need"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots"))
    values = lambda side: F.size(F.array_distinct(F.transform("slots", lambda z: z[side])))
    raw = F.col("way") == _RAW
    enough = F.when(raw, (F.col("n_heavy") >= F.col("need")) | (F.col("n_windows") >= F.col("of"))).otherwise(F.col("n_windows") >= F.col("need"))
    good = lines.filter(enough & (values("a") == F.size("slots")))
    # Ways of one alignment see different slots: all must be the same.
    places = good.groupBy("doc_id", "item_id", F.when(~raw, F.col("shift")).alias("shift")).agg(
        F.max("n_windows").alias("n_windows"), F.max(F.col("n_windows") / F.col("of")).alias("coverage"), F.min(F.when(~raw, F.forall("slots", lambda z: z["a"] == z["b"]))).alias("same"))
    return places.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("coverage").alias("coverage"), F.coalesce(F.max("same"), F.lit(True)).alias("same_values"), F.lit(True).alias("contaminated"))


@query("op6_decontamination")
def op6_decontamination(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

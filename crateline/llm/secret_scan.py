"""Secret scan: rules, and character Markov models of random strings and of ordinary identifiers.

Two models of the characters of a run are trained from labelled samples: what the rules find and
strings made at random from stated alphabets are random, all other runs of the same characters
are ordinary. The logarithm of the ratio of a run's two likelihoods is a sum over its characters;
the stretches of a run with the greatest sums, if great enough, are reported beside the rules' finds.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_step, columns_of, table
from .registry import query

KINDS = ("assign", "access", "hex", "random")
#: The rules: keyword and value (group 2 has at least 12 characters), access keys (18), hexadecimal runs (16).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: The characters that the models know, each with a number from 1; 0 stands before a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIZE = len(ALPHABET) + 1
_NUMBER = np.zeros(256, np.uint8)
_NUMBER[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, SIZE)
#: Alphabets of random strings: hexadecimal, base 32, base 36, base 62, base 64 and its form for file names.
RANDOM_ALPHABETS = (ALPHABET[52:62] + ALPHABET[26:32], ALPHABET[:26] + ALPHABET[54:60], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "-_")


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """What the rules find: (start, end, index of the kind), in code points, by start and then kind."""
    found = [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_CHARS]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_CHARS]
    return sorted(found, key=lambda s: (s[0], s[2]))


def random_strings(each: int, least: int = 20, most: int = 64) -> list[str]:
    """``each`` strings over every alphabet of random strings, the same ones at every call."""
    made = []
    for k, letters in enumerate(RANDOM_ALPHABETS):
        draw = np.random.default_rng(k)
        made += ["".join(letters[i] for i in draw.integers(0, len(letters), n)) for n in draw.integers(least, most + 1, each)]
    return made


def samples(docs: DataFrame, fit_docs: int = 10_000, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled runs of a bounded sample of the texts: ``label`` (1 random, 0 ordinary) and ``runs``.

    About ``fit_docs`` distinct texts are taken, by a hash of the text, whatever the size of the
    table: more of them would only put more of the secrets that no rule finds among the ordinary
    runs. Ordinary are all runs of at least ``least`` known characters that touch no find of the rules.
    """
    rows = columns_of(docs, id_col, text_col)
    share = min(1.0, fit_docs / max(1, rows.count()))
    placed = rows.select("text", F.xxhash64("text").alias("hash")).filter("text is not null")
    taken = placed.filter((F.shiftrightunsigned("hash", 1) / float(1 << 63)) < share).dropDuplicates(["hash"]).select("text")
    known = re.compile(f"[A-Za-z0-9+/_.=-]{{{least},}}")

    def label(step):
        runs = ([], [])
        for text in step.column(0).to_pylist():
            spans = rule_spans(text)
            runs[1].extend(ASSIGN.fullmatch(text[a:b])[2] if kind == 0 else text[a:b] for a, b, kind in spans)
            free = _free(spans, len(text))
            runs[0].extend(m[0] for a, b in free for m in known.finditer(text, a, b))
        return pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(runs), pa.list_(pa.string()))], ["label", "runs"])
    return arrow_step(taken, label, "label int, runs array<string>")


def _free(spans: list[tuple[int, int, int]], end: int) -> list[tuple[int, int]]:
    """What lies between the spans, without the runs that go on from them."""
    at, free = 0, []
    for a, b, _ in spans:
        free.append((at, a))
        at = max(at, b)
    return [(a, b) for a, b in [*free, (at, end)] if a < b]


def numbers_of(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The runs' characters as numbers, two zeros before each, and the places of the characters themselves."""
    codes = _NUMBER[np.frombuffer(("".join("\0\0" + r for r in runs)).encode(), np.uint8)].astype(np.int64)
    return codes, np.flatnonzero(codes)


def contexts(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of each character with the two before it."""
    return (codes[at - 2] * SIZE + codes[at - 1]) * SIZE + codes[at]


@dataclass(frozen=True)
class Model:
    """Log2 of the ratio of the two likelihoods of a character after two others (random over ordinary)."""

    ratio: np.ndarray

    def of(self, run: str) -> np.ndarray:
        """What each character of a run adds."""
        codes, at = numbers_of([run])
        return self.ratio[contexts(codes, at)]


def likelihoods(counts: np.ndarray, prior: float, whole: np.ndarray | None = None) -> np.ndarray:
    """P(c | a, b) of every triple, each order backed by the next lower one as ``prior`` counts, at last by even shares.

    ``whole`` are more counts of triples, which the lower orders do not learn from.
    """
    three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    lowest = (one + prior / (SIZE - 1)) / (one.sum() + prior)
    middle = (two + prior * lowest) / (two.sum(axis=1, keepdims=True) + prior)
    if whole is not None:
        three = three + whole.reshape(three.shape)
    return ((three + prior * middle) / (three.sum(axis=2, keepdims=True) + prior)).ravel()


def plain_strings() -> list[str]:
    """Rulers and lists of letters: one character again and again, and the alphabet's own order."""
    return [*(letter * 64 for letter in ALPHABET), *(ALPHABET[a:b] * 2 for a, b in ((0, 26), (26, 52), (52, 62)))]


def fit(labelled: DataFrame, prior: float = 500.0, drawn: int = 2000, even: float = 0.05) -> Model:
    """Train both models from ``label, runs``; ``drawn`` strings over each alphabet join the random ones, plain strings the ordinary ones.

    ``even`` of an ordinary character's likelihood is an even share, so that what was never seen is
    not yet random. The counts that reach the driver are at most two for each three characters of the alphabet.
    """
    def count(step):
        told = []
        for label, runs in zip(*(c.to_pylist() for c in step.columns), strict=True):
            n = np.bincount(contexts(*numbers_of(runs)), minlength=SIZE ** 3) if runs else np.zeros(SIZE ** 3, np.int64)
            told.append((label, np.flatnonzero(n), n))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(at), label) for label, at, _ in told]), pa.int32()),
                                           pa.array(np.concatenate([at for _, at, _ in told]), pa.int32()), pa.array(np.concatenate([n[at] for _, at, n in told]), pa.int64())], ["label", "gram", "n"])
    counted = labelled.select("label", "runs").mapInArrow(lambda batches: (count(b) for b in batches if b.num_rows), "label int, gram int, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, SIZE ** 3))
    for row in counted.toLocalIterator():
        counts[row["label"], row["gram"]] = row["n"]
    counts[1] += np.bincount(contexts(*numbers_of(random_strings(drawn))), minlength=SIZE ** 3)
    plain = np.bincount(contexts(*numbers_of(plain_strings())), minlength=SIZE ** 3)
    ordinary, chance = likelihoods(counts[0], prior, plain), likelihoods(counts[1], prior)
    return Model(np.log2(chance / ((1 - even) * ordinary + even / (SIZE - 1))).astype(np.float32))


def stretches(adds: np.ndarray, bits: float, least: int) -> list[tuple[int, int]]:
    """Disjoint stretches of greatest sum, of at least ``bits`` and ``least`` characters, best ones first."""
    waiting, found = [(0, len(adds))], []
    while waiting:
        a, b = waiting.pop()
        if b - a < least:
            continue
        sums = np.concatenate([[0.0], np.cumsum(adds[a:b], dtype=float)])
        lowest = np.minimum.accumulate(sums)
        end = int(np.argmax(sums - lowest))
        if sums[end] - lowest[end] < bits:
            continue
        start = int(np.argmin(sums[:end + 1]))
        if end - start >= least:
            found.append((a + start, a + end))
        waiting += [(a, a + start), (a + end, b)]
    return sorted(found)


def random_spans(text: str, rules: list[tuple[int, int, int]], model: Model, bits: float, least: int) -> list[tuple[int, int, int]]:
    """Stretches of runs that look random and touch no find of the rules."""
    found = []
    ends = sorted({x for a, b, _ in rules for x in (a, b)})
    for m in re.finditer(f"[A-Za-z0-9+/_.=-]{{{least},}}", text):
        cuts = [m.start(), *(x for x in ends if m.start() < x < m.end()), m.end()] if ends else [m.start(), m.end()]
        adds = model.of(m[0])
        for a, b in pairwise(cuts):
            if b - a >= least and not any(x < b and a < y for x, y, _ in rules):
                found += [(a + s, a + e, 3) for s, e in stretches(adds[a - m.start():b - m.start()], bits, least)]
    return found


def scan(docs: DataFrame, model: Model, bits: float = 30.0, least: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every text: ``doc_id, spans``, spans an array of (kind, start, end, value) by start, then kind.

    Places are code points, ends exclusive; a rule's span is its whole match. Kind ``random`` is a
    stretch of at least ``least`` characters whose likelihoods' ratio is at least 2 to the ``bits``; rules'
    finds stay as they are and such stretches do not touch them. Rules for odd input: null and
    empty texts have no spans; texts are read whole, of any length; each row stands for itself,
    repeated or null ids too; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.ratio)  # SIZE**3 numbers, 1.3 MB

    def find(step):
        ids, texts = step.columns
        found, own = [], Model(sent.value)
        for text in texts.to_pylist():
            rules = rule_spans(text or "")
            spans = sorted(rules + random_spans(text or "", rules, own, bits, least), key=lambda s: (s[0], s[2]))
            found.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, b, k in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        return pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], ["doc_id", "spans"])
    return arrow_step(columns_of(docs, id_col, text_col), find, "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>")


@query("op11_secret_scan")
def op11_secret_scan(spark, folder):
    docs = table(spark, folder, "documents")
    found = scan(docs, fit(samples(docs)))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    rules = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(rules), 256).alias("base_sha256"), joined("spans").alias("spans"))

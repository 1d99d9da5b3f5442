"""Names, paths and free text. Unicode normal forms need Python, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import Col, col

# Words that mark a mix by name.
MIX_WORDS = (
    "megamix", "mega mix", "medley", "mashup", "mash up", "mash-up", "mixed by", "in the mix",
    "party mix", "supermix", "mastermix", "mini mix", "minimix", "non-stop", "nonstop",
    "continuous", "dj set", "live set", "yearmix", "year mix",
)


def _fold(text: str | None) -> str | None:
    if text is None:
        return None
    flat = unicodedata.normalize("NFKD", text).casefold()
    return flat if flat.isascii() else "".join(c for c in flat if not unicodedata.combining(c))


#: Text bytes that are Python strings at once, whatever a batch holds.
STEP_BYTES = 1 << 20


def _in_steps(texts: pa.Array, work: Callable[[str], str]) -> pa.Array:
    """``work`` on every text; a batch stays Arrow memory, only a step of it becomes Python strings."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    told, at = [], 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + STEP_BYTES)))
        told.append(pa.array([None if t is None else work(t) for t in texts.slice(at, end - at).to_pylist()], pa.string()))
        at = end
    return pa.concat_arrays(told) if told else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def folded(text: pa.Array) -> pa.Array:
    """Case and accents removed; other scripts stay."""
    return _in_steps(text, _fold)


@F.arrow_udf(T.StringType())
def composed(text: pa.Array) -> pa.Array:
    """NFC, for equality of paths."""
    return _in_steps(text, lambda t: unicodedata.normalize("NFC", t))


@F.pandas_udf(T.BooleanType())
def is_composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.is_normalized("NFC", t)).astype("boolean")


def base_name(path: Col) -> Column:
    return F.regexp_extract(col(path), "([^/]*)$", 1)


def parent(path: Col) -> Column:
    return F.regexp_replace(col(path), "/[^/]*$", "")


def suffix(path: Col) -> Column:
    """Last extension with its dot, as it stands; hidden names have none."""
    return F.regexp_extract(base_name(path), "^.+(\\.[^.]+)$", 1)


def stem(path: Col) -> Column:
    return F.regexp_replace(base_name(path), "(?<=.)\\.[^.]+$", "")


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def normalized_name(path: Col) -> Column:
    return _words(folded(stem(path)))


def song_key(path: Col) -> Column:
    """Which song a file is: brackets, leading track number and trailing number gone."""
    plain = folded(stem(path))
    text = _words(F.regexp_replace(plain, "[(\\[][^)\\]]*[)\\]]", " "))
    text = F.regexp_replace(text, "^[0-9]{1,3} ", "")
    text = F.trim(F.regexp_replace(text, " [0-9]{1,4}$", ""))
    return F.coalesce(F.nullif(text, F.lit("")), _words(plain))


def absolute_path(path: Col, root: str = "/") -> Column:
    """Absolute normal path text: doubled slashes, ``.`` and ``..`` resolved."""
    full = F.when(col(path).startswith("/"), col(path)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), col(path)))
    pieces = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        pieces,
        F.expr("cast(array() as array<string>)"),
        lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.lit(0), F.size(out) - 1)))
        .otherwise(F.concat(out, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def under(path: Col, root: str) -> Column:
    """The root itself or anything below it, on a folder boundary."""
    root = root.rstrip("/")
    return (col(path) == root) | col(path).startswith(root + "/")


def file_uri_path(uri: Col) -> Column:
    """Path of a file:// address, percent escapes decoded; a plus sign stays a plus."""
    rest = F.regexp_replace(col(uri), "^file://[^/]*", "")
    rest = F.regexp_replace(rest, "[?#].*$", "")
    return F.url_decode(F.regexp_replace(rest, "\\+", "%2B"))


def has_all_words(haystack: Col, words: list[str]) -> Column:
    """Every word somewhere in the text, whatever the case and the accents."""
    hay = folded(F.coalesce(col(haystack), F.lit("")))
    out = F.lit(True)
    for word in words:
        out = out & hay.contains(_fold(word))
    return out


def has_all_words_collated(haystack: Col, words: list[str]) -> Column:
    """The same test inside the JVM, on an accent- and case-insensitive collation."""
    hay = F.collate(F.coalesce(col(haystack), F.lit("")), "UNICODE_CI_AI")
    out = F.lit(True)
    for word in words:
        out = out & F.contains(hay, F.collate(F.lit(word), "UNICODE_CI_AI"))
    return out


def parse_words(text: str) -> list[str]:
    return [w.strip().lower() for w in text.split(",") if w.strip()]


def _escaped(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)


def matching_words(name: Col, words=MIX_WORDS) -> Column:
    """Distinct whole-word hits, sorted; longer words are tried first."""
    if not words:
        return F.expr("cast(array() as array<string>)")
    either = "|".join(sorted((_escaped(w) for w in words), key=len, reverse=True))
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(F.lower(col(name)), F.lit(f"\\b(?:{either})\\b"), F.lit(0))))


def looks_like_mashup(name: Col) -> Column:
    return F.regexp_count(F.lower(col(name)), F.lit("\\bvs\\b")) >= 2

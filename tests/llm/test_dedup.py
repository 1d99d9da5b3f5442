import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from crateline.llm import exact_dedup, jaccard_join, line_dedup, suffix_dedup
from crateline.llm.common import code_tokens, words_of
from crateline.llm.exchange import unpacked

from .conftest import prose, texts_of


def bag(rows):
    return Counter(map(tuple, rows))


def test_lines_shared_by_documents_go_but_in_the_last(odd):
    docs, held = texts_of(odd), defaultdict(set)
    key = lambda line: line.encode().strip().lower().decode()
    for i, text in docs:
        for line in text.split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    expected = []
    for i, text in docs:
        lines = text.split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or i == max(d for d in held[key(x)] if d is not None)]
        expected.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = line_dedup.line_dedup(odd).collect()
    assert bag(found) == bag(expected) and any(r.n_dropped for r in found)


def test_keys_of_lines_are_made_once(spark):
    long = "a line of more than twenty signs"
    texts = [f"{long} \u00c9", f"\t{long.upper()} \u00c9\r", f"{long} \u00c9\n{long} \u00c9", f"{long} \u00e9", f"{long}\u00a0", "    short line           ", None, ""]
    docs = spark.createDataFrame([*enumerate(texts), (5, texts[5]), (9, texts[5])], "doc_id long, text string")
    found = line_dedup.line_dedup(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "translate" not in plan and "Generate" not in plan
    told = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()}
    assert told[0] == told[1] == (1, 1, "") and told[2] == (2, 0, texts[2])  # accents keep their case
    assert all(told[k] == (1, 0, texts[k] or "") for k in (3, 4, 5, 6, 7))


def test_lines_of_an_empty_table(none):
    assert line_dedup.line_dedup(none).count() == 0


def test_exact_copies_keep_the_smallest_id(odd):
    docs, groups = texts_of(odd), defaultdict(list)
    digest = lambda t: hashlib.sha256(re.sub("[\\x20\\x09-\\x0D]+", " ", t).encode()).hexdigest()
    for i, text in docs:
        groups[digest(text)].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    found = exact_dedup.exact_dedup(odd, fan=2, rounds=3).collect()
    assert bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == bag((i, least(groups[digest(t)]), len(groups[digest(t)]), digest(t)) for i, t in docs)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert kept == Counter(set(groups)) and all(r.doc_id == r.keep_id for r in found if r.kept)


def test_tree_merge_verifies_digests(spark):
    rows = [(b"same", 1, 5, 9, 1), (b"same", 2, 5, 3, 1), (b"same", 1, 5, 4, 2)]
    runs = spark.createDataFrame(rows, "digest binary, check long, n_bytes long, keep_id long, n_rows long").repartition(3)
    found = exact_dedup.tree_merge(runs, fan=3, rounds=2).collect()
    assert {(r.check, r.keep_id, r.n_rows) for r in found} == {(1, 4, 3), (2, 3, 1)}


def test_exact_copies_of_an_empty_table(none):
    assert exact_dedup.exact_dedup(none, fan=2, rounds=1).count() == 0


def _classes(docs, threshold=0.8, size=5):
    shingles = {}
    for i, text in docs:
        w = words_of(text)
        n = min(size, len(w))
        shingles[i, text] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    last = 2**63
    rep = {}
    for (i, _), s in shingles.items():
        rep[s] = min(rep.get(s, last), last if i is None else i)
    sets = list(rep)
    links, root = Counter(), {s: s for s in sets}

    def top(s):
        while root[s] != s:
            s = root[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[:k]:
            if a and b and len(a & b) >= threshold * len(a | b):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for s in sets:
        least[top(s)] = min(least.get(top(s), last), rep[s])
    real = lambda i: None if i == last else i
    return [(i, real(least[top(shingles[i, t])]), real(rep[shingles[i, t]]), links[shingles[i, t]], len(shingles[i, t])) for i, t in docs]


def test_jaccard_join_of_odd_rows(odd):
    assert bag(jaccard_join.jaccard_join(odd).collect()) == bag(_classes(texts_of(odd)))


def test_jaccard_join_splits_and_blocks_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rows = []
    for i in range(60):  # near copies of one text, more or less changed
        words = prose(50, 200).split()
        for k in range(i % 7):
            words[(i * 13 + k * 29) % 200] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(100 + i, 60)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert bag(jaccard_join.jaccard_join(docs).collect()) == bag(_classes(rows))


def test_runs_reach_the_recall_over_the_sketch():
    # The runs share T coordinates: draw how many agree, then let every run meet or not, by the recursion of a node's samples.
    pick, rate = np.random.default_rng(5), 1 / (0.8 * jaccard_join.T)
    runs, sure = jaccard_join.runs_for(0.9999, 0.8), jaccard_join.sure_for(0.9999, 0.8)
    same = pick.binomial(jaccard_join.T, 0.8, 2_000_000)
    meets = np.ones(jaccard_join.T + 1)
    for _ in range(jaccard_join.DEPTH):
        x = np.arange(jaccard_join.T + 1) / jaccard_join.T * meets
        none = (1 - rate) ** jaccard_join.T  # a node that samples nothing takes one coordinate
        meets = 1 - ((1 - rate * x) ** jaccard_join.T - none * x)
    found = ((1 - (1 - meets) ** runs)[same] * (same >= sure)).mean()
    assert found >= 0.9999 - 1e-5 and runs == 9


def test_jaccard_join_of_an_empty_table(none):
    assert jaccard_join.jaccard_join(none).count() == 0


def test_components_of_long_paths(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40) if i != 20] + [("z", "y")]
    found = dict(jaccard_join.components(spark.createDataFrame(edges, "key string, root string")).collect())
    assert {found[f"n{i:03}"] for i in range(21)} == {"n000"} and {found[f"n{i:03}"] for i in range(21, 41)} == {"n021"} and found["z"] == "y"


def _without_repeats(docs, span=200):
    data = [t.encode() for _, t in docs]
    seen = Counter(d[k:k + span] for d in data for k in range(len(d) - span + 1))
    out = []
    for (i, _), d in zip(docs, data, strict=True):
        lost = np.zeros(len(d), bool)
        for k in range(len(d) - span + 1):
            if seen[d[k:k + span]] > 1:
                lost[k:k + span] = True
        runs = int((np.diff(np.concatenate([[0], lost.astype(int)])) == 1).sum())
        out.append((i, len(d), runs, bytes(np.frombuffer(d, np.uint8)[~lost])))
    return out


def _repeats(docs):
    return bag((r.doc_id, r.n_bytes, len(r.starts) // 8, bytes(r.kept)) for r in suffix_dedup.repeats(docs).collect())


def test_repeated_bytes_of_odd_rows(odd):
    assert _repeats(odd) == bag(_without_repeats(texts_of(odd)))


def test_repeated_bytes_at_every_offset_and_in_periodic_text(spark):
    passage = prose(9, 90)
    rows = [(i, prose(20 + i, 30 + i) + passage[i:i + 199 + i % 3] + prose(60 + i, 40)) for i in range(24)]
    rows += [(100, "ab" * 400), (101, passage), (102, "c" * 250 + prose(77, 50)), (103, "c" * 199 + "d"), (104, "é" * 150 + "c" * 120), (105, passage[40:300] + passage[:220])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _repeats(docs) == bag(_without_repeats(rows))


def test_only_the_ends_of_repeats_reach_the_sort(spark, monkeypatch):
    lines, passages = [prose(k, 40)[:150] for k in range(40)], [prose(500 + k, 300) for k in range(3)]
    rows = [(i, "\n".join(random.Random(i).sample(lines, 20)) + passages[i % 3] + prose(900 + i, 50)) for i in range(30)]
    windows, own = [], suffix_dedup._suffix_array

    def counted(cores, buckets):
        windows.extend(int((unpacked(r.sizes)[0] - 199).sum()) for r in cores.collect())
        return own(cores, buckets)

    monkeypatch.setattr(suffix_dedup, "_suffix_array", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert _repeats(docs) == bag(_without_repeats(rows))
    assert 0 < sum(windows) < sum(len(t) for _, t in rows) // 20  # lines of 150 bytes are shared, but no 200 bytes across them


def test_repeated_bytes_of_documents_longer_than_a_piece(spark):
    long = prose(1, 12000)
    rows = [(1, long), (2, prose(2, 9000) + long[30000:40000] + prose(3, 100)), (3, "x" * (suffix_dedup.PIECE + 300)), (4, long[100:299] + "y"), (5, long[65400:65600])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert _repeats(docs) == bag(_without_repeats(rows))


def test_merge_needs_no_order_beyond_the_prefix():
    # Two suffixes of one prefix in classes 1 and 2, and one of another in class 0 that differs behind the fifth character only in rank.
    record = lambda char, second, kind, own, one, two, span: [np.array([x], np.uint64) for x in (char, second, kind, own, one, two, span)] + [np.array([1], np.uint32)]
    told = suffix_dedup._merged([record(5, 6, 1, 9, 4, 0, 77), record(5, 6, 2, 9, 0, 3, 77), record(5, 6, 0, 0, 5, 8, 78)])
    assert [int(t[0][0]) for t in told] == [1, 1, 0]


def test_repeated_bytes_of_an_empty_table(none):
    assert suffix_dedup.repeats(none).count() == 0


def test_queries_agree_with_sql(spark):
    import duckdb

    from crateline import llm

    db, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "pages"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in llm.oracle_sql().items():
        found = llm.queries()[name](spark, folder)
        columns = sorted(found.columns)
        assert bag(found.select(*columns).collect()) == bag(db.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), name


def test_tokens_are_looked_up_once():
    class Token(bytes):
        looked_up = 0

        def __hash__(self):
            Token.looked_up += 1
            return super().__hash__()

    words = [b"b", b"a", b"c", b"a"] * 250
    tokens, at, sizes = code_tokens([list(map(Token, words)), [], [Token(b"d")]])
    # Once for each token, and once more for each new one, which is put in.
    assert Token.looked_up <= len(words) + 1 + 2 * 4
    assert tokens == [b"b", b"a", b"c", b"d"] and at.tolist() == [0, 1, 2, 1] * 250 + [3] and sizes.tolist() == [1000, 0, 1]


def test_sketches_read_their_signature_once(spark):
    signs = np.random.default_rng(2).integers(0, 2**32, (20, jaccard_join.T), dtype=np.uint32)
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(signs)], "id int, sig binary")
    found = df.select("id", jaccard_join._low_bytes(F.col("sig")).alias("sketch"))
    assert {r.id: bytes(r.sketch) for r in found.collect()} == {i: s.astype(np.uint8).tobytes() for i, s in enumerate(signs)}
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crateline.llm import decontamination, exchange, katz, language_id, packing, token_file, tokens, warc
from crateline.llm.common import words_of

from .conftest import prose, texts_of

PATH = tokens.vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zé", "ß", " ", "  ", "\n", "\t", ".", ",", "'s", "don't", "12", "\0", "é", "Ω", "日", " ", " ", "<|endoftext|>", "{}", "🙂", "\r\n", "×"])).map("".join))
def test_coder_gives_the_ids_of_the_library(text):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH) if not hasattr(test_coder_gives_the_ids_of_the_library, "made") else test_coder_gives_the_ids_of_the_library.made
    made.encode_special_tokens = True
    test_coder_gives_the_ids_of_the_library.made = made
    assert np.frombuffer(tokens.coder(PATH).code([text, None])[0], "<u4").tolist() == made.encode(text, add_special_tokens=False).ids


# Token files


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=400), st.integers(1, 9), st.integers(1, 8))
def test_blocks_round_trip_and_decode_from_checkpoints(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    freq = token_file.frequencies(np.bincount(ids, minlength=300), 12)
    assert int(freq.sum()) in (0, 1 << 12)
    lengths = np.array([len(ids) // 3, len(ids) - len(ids) // 3])
    data = token_file.write_block([7, None], lengths, ids, 40, freq, 12, lanes, every)
    doc_ids, found, first, back = token_file.read_block(data, freq, token_file.symbols(freq))
    assert (doc_ids, found.tolist(), first, back.tolist()) == ([7, None], lengths.tolist(), 40, ids.tolist())
    lanes = min(lanes, max(1, len(ids)))
    pieces = range(-(-len(ids) // (lanes * every)))
    assert [x for p in pieces for x in token_file.read_block(data, freq, token_file.symbols(freq), p)[3].tolist()] == ids.tolist()


def test_frequencies_keep_rare_symbols():
    counts = np.array([10**9, 1, 0] + [1] * 3000)
    freq = token_file.frequencies(counts, 12)
    assert freq.sum() == 1 << 12 and (freq[counts > 0] > 0).all() and freq[2] == 0


def test_damaged_blocks_are_refused():
    freq = token_file.frequencies(np.array([3, 1]), 12)
    data = bytearray(token_file.write_block([1], np.array([4]), np.array([0, 1, 0, 0]), 0, freq, 12))
    data[-9] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_file.read_block(bytes(data), freq, token_file.symbols(freq))


def test_token_files_of_odd_rows(spark, odd, tmp_path, library):
    token_file.write_tokens(odd, str(tmp_path / "t"), PATH, block=500)
    found = token_file.read_tokens(spark, str(tmp_path / "t")).collect()
    assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in found) == Counter((i, crc([*library(t), 2])) for i, t in texts_of(odd))
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order)


def test_token_files_of_an_empty_table(spark, none, tmp_path):
    token_file.write_tokens(none, str(tmp_path / "t"), PATH)
    assert token_file.read_tokens(spark, str(tmp_path / "t")).count() == 0


# Packing


def _check_packing(found, capacity):
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_odd_rows(spark, odd, library):
    places, made = packing.pack(odd.repartition(3), PATH, capacity=256)
    found = places.collect()
    expected = Counter()
    for i, t in texts_of(odd):
        ids = [*library(t), 0]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids), 256)] if len(ids) > 256 else [0]
        expected.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    bins = _check_packing(found, 256)
    assert bins <= 1 + -(-sum(r.length for r in found) // 256)
    whole = packing.sequences(places, made).collect()
    assert len(whole) == bins and Counter(x for r in whole for x in r.ids) == Counter(x for _, t in texts_of(odd) for x in [*library(t), 0])


def test_packing_of_an_empty_table(none):
    assert packing.pack(none, PATH)[0].count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=40))
def test_bins_hold_every_length_once_and_the_first_is_the_fullest(lengths):
    counts = np.bincount(lengths, minlength=25)
    plan, bins = packing.plan_bins(counts, 24), defaultdict(int)
    for length, first, last, start, times, _ in plan:
        for rank in range(first, last):
            bins[start + (rank - first) // times] += length
    assert Counter({l: 0 for l in []}) == Counter() and sum(bins.values()) == sum(lengths) and max(bins.values()) <= 24
    longest, rest = max(lengths), sorted(lengths)[:-1]
    sums = {0}
    for x in rest:
        sums |= {s + x for s in sums if s + x <= 24 - longest}
    assert bins[0] == longest + max(sums)


def test_queries_code_names_of_special_tokens_as_the_unmodified_library(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    made = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain text, no name", "x<|endoftext|><|endoftext|>  y\n<|endoftext|>", "<|endoftext |> a <|endoftext|", None, prose(1, 30) + " <|endoftext|> " + prose(2, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = [made.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids[0] == [64, 220, 50256, 275]
    found = token_file.op3_token_file(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == [(k, len(x) + 1, crc([*x, 2])) for k, x in enumerate(ids)]
    for places in (packing.op5_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        assert sorted((r.doc_id, r.length, r.ids_crc32) for r in places.collect()) == [(k, len(x) + 1, crc([*x, 0])) for k, x in enumerate(ids)]


# Archives


def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(3, "http://a/\r\nx", long), (1, "http://b", long), (2, None, long), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, None, ""), (8, "u", "z" * 3_000_000),
            (None, "u", long), (9, "u", "y" * 150), (9, "u", "y" * 150)]
    pages = spark.createDataFrame([(*r, "k", b"d", 1) for r in rows], "page_id long, url string, html string, key string, payload_digest binary, n int")
    warc.write_archives(pages.repartition(3), str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w")).collect()
    body = {3: long, 1: long, 2: long, None: long}
    expected = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        again = i in body and i != 1
        expected[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected
    assert {r.page_id: bytes(r.payload).decode() for r in found if r.record_type == "response"}[1] == long


def test_archives_of_an_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


# Language


def test_forward_sums_all_segmentations():
    pieces = {"▁": 2, "▁a": 3, "a": 4, "ab": 5, "b": 6, "▁ab": 7}
    prob = np.array([[0.0], [0.05], [0.1], [0.2], [0.15], [0.1], [0.2], [0.2]])

    def total(rest):
        if not rest:
            return 1.0
        own = sum(prob[k, 0] * total(rest[len(p):]) for p, k in pieces.items() if rest.startswith(p))
        return own + (prob[1, 0] * total(rest[1:]) if rest[0] not in pieces else 0)

    lattice = language_id.Lattice(pieces)
    for word in ("ab", "aab", "bxa", "a"):
        assert lattice.logs([word], prob)[0, 0] == pytest.approx(math.log(total("▁" + word)))
    # Expected uses weigh every segmentation: each explains the whole word.
    uses = lattice.expected(["aab"], np.array([[2.0]]), prob)
    assert sum(uses[k, 0] * len(p) for p, k in pieces.items()) == pytest.approx(2 * len("▁aab"))


def test_languages_are_told_apart(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = language_id.identify(docs, language_id.vocabulary(), per_language=40, rounds=2).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) > 0.97 * len(found)


def test_languages_of_odd_rows(odd, none):
    path = language_id.vocabulary()
    found = language_id.identify(odd, path, rounds=1).collect()
    assert len(found) == len(texts_of(odd)) and all(0 <= r.score <= 1 for r in found)
    letters = {i: any(c.isalpha() for c in t) for i, t in texts_of(odd)}
    assert all((r.lang_pred != "und") == letters[r.doc_id] for r in found)
    assert language_id.identify(none, path).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string")), path).collect()} == {"und"}
    learned = language_id.learn(odd, path, rounds=1)
    kept = language_id.accept(odd, *learned, path, 0.5)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {i for i, yes in letters.items() if yes}


# Decontamination


def test_asked_again_with_other_numbers_and_names(spark):
    item = "At the market Mary bought 12 apples and then Mary gave 5 apples to the boy, so how many apples has she left of 12 kg?"
    changed = item.replace("Mary", "Paula").replace("12", "31").replace("5", "8")
    mixed_up = "At the market Mary bought 12 apples and then Paula gave 12 apples to the boy, so how many apples has she left of 7 kg?"
    docs = [(1, prose(1, 50) + ". " + item + " " + prose(2, 50)), (2, changed), (3, mixed_up), (4, prose(3, 200)), (5, " ".join(item.split()[:9])), (None, item), (6, None), (7, "")]
    bench = [(1, item), (2, None), (3, ""), (4, "too short"), (5, prose(9, 6))]
    frame = lambda rows, name: spark.createDataFrame([(*r, 1, "s") for r in rows], f"{name} long, text string, key int, slots string")
    found = {(r.doc_id, r.item_id): r.same_values for r in decontamination.contaminated(frame(docs, "doc_id"), frame(bench, "item_id")).collect()}
    assert found == {(1, 1): True, (None, 1): True, (2, 1): False}
    assert decontamination.contaminated(frame(docs, "doc_id").limit(0), frame(bench, "item_id")).count() == 0
    assert decontamination.contaminated(frame(docs, "doc_id"), frame(bench, "item_id").limit(0)).count() == 0


def test_exact_copies_of_slot_heavy_and_short_items_are_found(spark):
    items = ["What is 12 + 15 + 3?", "Compute 12 + 15 - 3 + 8 * 4 / 2 and give 5 digits.", "Anna Smith, Bob Jones, Carl Lee", "Die Stadt Bonn am Rhein mit Schloss, Dom, Markt und Hafen",
             "name a river"]
    other = ["what is 13 + 15 + 3?", "Compute 12 + 15 - 3 + 8 * 4 / 2 and give 6 digits.", "Anna Smith, Bob Jones, Carl Low", "Die Stadt Köln am Main mit Turm, Tor, Haus und Hof", "name a lake"]
    docs = [(k, prose(k, 40) + ". " + t + " " + prose(20 + k, 40)) for k, t in enumerate(items + other)]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.same_values) for r in found.collect()} == {(k, k, True) for k in range(len(items))} | {(8, 3, False)}  # the last with other names


def test_what_stands_around_a_passage_does_not_change_its_windows(spark):
    items = ["What is the capital of the country where Mary lives?", "The baker sold 12 rolls to a boy. The rest went to 3 girls. The mother paid for all of them.",
             "Days of rain in the north and the south of Spain", "Tom has 5 old red pears. She ate 2 of them at noon. Sam took what was left over."]
    again = ["What is the capital of the country where Paula lives?", items[1].replace("12", "31").replace("3 ", "8 "), "Days of rain in the north and the south of Chile",
             items[3].replace("5", "7").replace("Tom", "Pat").replace("Sam", "Kim")]
    around = ["Question: ", "He wrote in The Times. " + prose(1, 30) + ". ", "Here were 5 ", prose(2, 30) + ". "]
    docs = [(k, a + t) for k, (a, t) in enumerate(zip(around * 2, items + again, strict=True))] + [(20, "The capital of the country is where the north lives")]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.same_values) for r in found.collect()} == {(k, k, True) for k in range(4)} | {(k + 4, k, False) for k in range(4)}


def test_planted_items_are_found_and_nothing_else(spark):
    folder = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    items = texts_of(bench.withColumnRenamed("item_id", "doc_id"))
    assert found == {(i, k) for i, t in texts_of(docs) for k, b in items if b in t}


# Katz


def _katz(docs, order, most=5):
    grams = lambda w, n: [tuple((["<s>"] * (n - 1) + w)[k:k + n]) for k in range(len(w))]
    coded = [(i, words_of(t) + ["</s>"], zlib.crc32(str("" if i is None else i).encode()) % 7 == 2) for i, t in docs]
    count = {n: Counter(g for _, w, out in coded if not out for g in grams(w, n)) for n in range(1, order + 1)}
    tokens_, types = sum(count[1].values()), len(count[1])
    factor, mass = {}, {}
    for n in count:
        factor[n] = katz.discounts(Counter(count[n].values()), most)
        after = defaultdict(list)
        for g, c in count[n].items():
            after[g[:-1]].append((g, c))
        for h, seen in after.items():
            total = sum(c for _, c in seen)
            kept = sum(c * factor[n][c] if c <= most else c for _, c in seen)
            divisor = total if kept < total - 1e-12 else total + 1
            lower = sum(prob(g[1:], n - 1, count, factor, mass, types, most) for g, _ in seen)
            mass[n, h] = divisor, (1 - kept / divisor) / (1 - lower)
    out = []
    for i, w, held_out in coded:
        known = sum((x,) in count[1] for x in w)
        base = sum(math.log10((count[1][(x,)] + 1) / (tokens_ + types + 1)) for x in w)
        out.append((i, held_out, len(w), known, tokens_, base, sum(math.log10(prob(g, order, count, factor, mass, types, most)) for g in grams(w, order))))
    return out, (count, factor, mass, types)


def prob(gram, n, count, factor, mass, types, most):
    if n == 0:
        return 1 / (types + 1)
    lower = prob(gram[1:], n - 1, count, factor, mass, types, most)
    if (n, gram[:-1]) not in mass:
        return lower
    divisor, weight = mass[n, gram[:-1]]
    c = count[n].get(gram, 0)
    return (c * factor[n][c] if c <= most else c) / divisor if c else weight * lower


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_scores_of_odd_rows(odd, order):
    expected, (count, factor, mass, types) = _katz(texts_of(odd), order)
    found = katz.score(odd.repartition(3), order=order).collect()
    short = lambda r: (r[0] is None, r[0] or 0, r[1:5], round(r[5], 5), round(r[6], 5))
    assert sorted(map(short, expected)) == sorted(map(short, found))
    # Every context's probabilities sum to one over the known words and one unknown word.
    for n, h in list(mass)[:50]:
        words = [g[0] for g in count[1]] + [b"\0unknown"]
        assert sum(prob((*h, w), n, count, factor, mass, types, 5) for w in words) == pytest.approx(1)


def test_katz_of_an_empty_table(none):
    assert katz.score(none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)), st.integers(1, 7))
def test_exchanges_keep_arrays_and_order(values, buckets):
    keys = np.unique(np.array(values, np.uint64))
    assert exchange.unpacked(exchange.packed(keys, keys.astype(np.int16)))[0].tolist() == keys.tolist()
    cuts = list(exchange.slices(keys, buckets))
    assert [x for _, a, b in cuts for x in keys[a:b]] == keys.tolist() and all(b * 2**64 <= int(keys[x]) * buckets for b, x, _ in cuts)


def test_numerals_that_are_no_letters_make_no_words():
    assert language_id.words("½ ² Ⅷ ① 12") == [] and language_id.words("m² ab½cd É") == ["m", "ab", "cd", "é"]


def test_a_worker_keeps_what_one_stage_needs():
    made = []
    make = lambda: made.append(1) or [len(made)]
    from crateline.llm.common import kept
    assert kept("a", make, "first") == kept("a", make, "first") == [1]
    assert kept("b", make, "second") == [2] and kept("a", make, "first") == [3]


def test_columns_of_spans_find_the_pieces_of_a_dictionary():
    pieces = {p: i for i, p in enumerate(["▁a", "ab", "b", "abc", "▁abca", "ca", "é"], 2)}
    lattice = language_id.Lattice(pieces)
    for word in ("▁abca", "▁abcé", "▁xabc"):
        found = {span: dict(zip(rows.tolist(), ids.tolist())) for span, (rows, ids) in lattice.arcs([word, word], len(word)).items()}
        expected = {(a, b): pieces.get(word[a:b], int(b == a + 1)) for a in range(len(word)) for b in range(a + 1, len(word) + 1)}
        assert found == {span: {0: i, 1: i} for span, i in expected.items() if i}

"""The ten operators against brute force, and on nulls, ties, repeats, empty and odd tables."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import byte_words, decontamination, exact_dedup, graph, language_model, packing, quality, simhash, substring_dedup, token_counts, toxicity, warc
from colloquy.llm.common import most_frequent, table, words_of
from colloquy.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def docs(spark, rows):
    """Documents with columns that also occur inside the operators."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("row", "unit", "rank", "stamp", "n", "fp", "label", "key", "anchor", "score", "_row", "first_id")})


# ---- substring dedup


def brute_substrings(rows, window=20):
    seen, out = {}, []
    order = sorted(((d is None, d or 0, k) for k, (d, _) in enumerate(rows)))
    for _, _, k in order:
        d, t = rows[k]
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - window + 1):
            s = tuple(w[j : j + window])
            place = (d is None, d or 0, j)
            if seen.setdefault(s, place) < place:
                gone.update(range(j, j + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def repeated_passages():
    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "a"]) if r.random() < 0.4 else f"v{r.randrange(400)}"
    passages = [" ".join(word() for _ in range(n)) for n in (19, 20, 21, 60)]
    rows = [(k, " ".join([word() for _ in range(r.randrange(0, 90))] + [r.choice(passages)] + [word() for _ in range(r.randrange(0, 60))])) for k in range(60)]
    rows += [(100, "be " * 70), (101, "a b c " * 30), (102, rows[3][1]), (103, None), (104, ""), (105, "\t \n"), (None, rows[5][1]), (106, passages[3] + "\n" + passages[3])]
    rows += [(107, rows[7][1]), (107, rows[7][1]), (108, rows[8][1]), (108, passages[3])]
    return rows


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substrings_match_brute_force(spark, hot):
    rows = repeated_passages()
    got = substring_dedup.deduplicate(docs(spark, rows), hot_runs=hot).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_substrings(rows)


def test_substrings_of_far_ids_and_long_texts(spark):
    rows = [(-(1 << 62), LONG), (1 << 62, LONG), (5, "short")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.deduplicate(docs(spark, rows)).collect()}
    assert got[1 << 62] == (30_000, 30_000) and got[5] == (1, 0) and got[-(1 << 62)][1] > 28_000


def low_gram():
    """Six words whose gram has the lowest hash of many, so that it is the anchor of most windows."""
    grams = [[f"g{k}x{j}" for j in range(6)] for k in range(60_000)]
    column = pa.array([" ".join(g) for g in grams])
    data, offsets = byte_words.buffers(column)
    h = byte_words.hashes(data, *byte_words.bounds(data, offsets))[0].reshape(-1, 6)
    total = np.zeros(len(h), np.uint64)
    for k in range(6):
        total = total * np.uint64(substring_dedup._MULTIPLIER) + h[:, k]
    return grams[int(np.argmin(byte_words.mix(total)))]


def around(gram, k):
    """Twenty words of their own around a gram."""
    return [f"a{k}n{j}" for j in range(7)] + gram + [f"a{k}n{j}" for j in range(7, 14)]


def test_different_runs_of_one_anchor_are_not_taken_as_copies(spark):
    gram = low_gram()
    *_, anchor, one, two = substring_dedup.runs([around(gram, k) for k in range(130_000)])
    common = np.unique(anchor, return_counts=True)[1].max()
    assert common > 120_000 and len(np.unique(one)) == len(np.unique(two)) == len(one)  # whole halves are all different
    order = np.argsort(one.view(np.uint64) >> np.uint64(32), kind="stable")
    upper = (one.view(np.uint64) >> np.uint64(32))[order]
    near = np.flatnonzero(upper[1:] == upper[:-1])
    doc = substring_dedup.runs([around(gram, k) for k in range(130_000)])[0][order]
    assert len(near)  # 32 bits would take these as equal
    rows = [(int(d), " ".join(around(gram, int(d)))) for k in near for d in (doc[k], doc[k + 1])]
    for hot in (5_000, 1):
        got = substring_dedup.deduplicate(docs(spark, rows), hot_runs=hot).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_substrings(rows)


def test_substrings_of_an_empty_table_and_of_clashing_columns(spark):
    assert substring_dedup.deduplicate(docs(spark, [])).count() == 0
    rows = [(2, "w " * 25), (1, "w " * 25)]
    d = docs(spark, rows).withColumn("rank", F.lit("x")).withColumn("stamp", F.lit(1.5)).withColumn("anchor", F.lit(None).cast("int"))
    got = substring_dedup.deduplicate(d).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(rows)


def test_ids_and_texts_that_need_more_bits_than_there_are_are_refused(spark, monkeypatch):
    rows = [(-(1 << 62), "a b"), (0, "c d"), (1 << 62, "a b")]
    monkeypatch.setattr(substring_dedup, "POSITION_BITS", 7)
    with pytest.raises(ValueError, match="ids at most"):
        substring_dedup.deduplicate(docs(spark, rows))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab\u00e9\u4e2d \t\n\x0b\x0c\r\x1c\x85\xa0"), max_size=60)), max_size=8), st.integers(1, 70), st.integers(0, 4))
def test_byte_words_are_the_words(texts, size, overlap):
    got, of = {}, {}
    for row, first, data, offsets in byte_words.pieces(pa.array(texts, pa.string()), overlap, size):
        start, end = byte_words.bounds(data, offsets)
        h = byte_words.hashes(data, start, end)
        begins = np.searchsorted(start, offsets)
        for k in range(len(offsets) - 1):
            for j in range(begins[k], begins[k + 1]):
                word = bytes(data[start[j] : end[j]]).decode()
                place = (row + k, first + j - begins[k])
                assert got.setdefault(place, word) == word and of.setdefault(word, h[:, j].tolist()) == h[:, j].tolist()
    assert got == {(k, j): w for k, t in enumerate(texts) for j, w in enumerate(words_of(t))}
    assert len({tuple(x) for x in of.values()}) == len(of)


def test_long_words_are_hashed_whole():
    words = ["x" * n for n in (4095, 4096, 4097, 9000)] + ["x" * 8999 + "y", "y" + "x" * 8999, "x" * 4096 + "y"]
    data, offsets = byte_words.buffers(pa.array([" ".join(words)]))
    h = byte_words.hashes(data, *byte_words.bounds(data, offsets))
    assert len(np.unique(h[0])) == len(np.unique(h[1])) == len(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=6), st.integers(2, 5))
def test_fm_index_finds_what_starts_earlier(texts, least):
    arrays = [np.array(t, np.int64) for t in texts]
    index = FMIndex(arrays, 4)
    got = [set() for _ in texts]
    for t, s, e in zip(*index.matches(arrays, index.begin, least), strict=True):
        got[t].update(range(s, e - least + 1))
    seen = set()
    for k, t in enumerate(texts):
        want = set()
        for j in range(len(t) - least + 1):
            s = tuple(t[j : j + least])
            if s in seen:
                want.add(j)
            seen.add(s)
        assert got[k] == want


# ---- decontamination


def brute_tiles(document, item, least):
    fd, fi, out = [True] * len(document), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i, d in itertools.product(range(len(item)), range(len(document))):
            n = 0
            while i + n < len(item) and d + n < len(document) and fi[i + n] and fd[d + n] and item[i + n] == document[d + n]:
                n += 1
            if n > best[0]:
                best = (n, i, d)
        n, i, d = best
        if n < least:
            return sorted(out)
        fi[i : i + n] = [False] * n
        fd[d : d + n] = [False] * n
        out.append((d, i, n))


def test_tiles_match_brute_force():
    r = random.Random(1)
    for t in range(400):
        a = r.choice([2, 3, 8])
        item = [r.randrange(1, a) for _ in range(r.randrange(0, 25))]
        document = [r.randrange(1, a) for _ in range(r.randrange(0, 30))]
        if t % 2:
            document = item[len(item) // 2 :] + [9] + item[: len(item) // 2] + document
        assert sorted(decontamination.tiles(document, item, 3)) == brute_tiles(document, item, 3)


def test_search_finds_what_tiling_of_whole_texts_finds():
    r = random.Random(8)
    stock = [f"s{k}" for k in range(9)]
    items = []
    for k in range(150):
        own = [f"w{r.randrange(60)}" for _ in range(r.randrange(1, 30))]
        at = r.randrange(len(own) + 1)
        items.append((k, " ".join(own[:at] + (stock if k % 2 else []) + own[at:])))
    index = decontamination.Benchmark.of(items)
    hashes = decontamination._Hashes()
    for _ in range(60):
        parts = [r.choice(items)[1].split() for _ in range(3)]
        words = [w for p in parts for w in (p[len(p) // 2 :] + p[: len(p) // 2] if r.random() < 0.5 else p[r.randrange(4) :])] + stock + ["...", "x"]
        h = hashes.of(" ".join(words))[0]
        want = {}
        for k, t in enumerate(index.tokens):
            covered = sum(n for *_, n in brute_tiles(h.tolist(), t, 5))
            if len(t) >= 5 and covered >= 0.6 * len(t):
                want[k] = covered
        assert {k: sum(n for *_, n in found) for k, found in index.search(h)} == want and want
    assert {k for k, _ in index.search(hashes.of(items[0][1])[0])} >= {0}


def test_repetitive_texts_and_common_phrases_stay_cheap():
    began = time.process_time()
    assert decontamination.tiles([1] * 20_000, [1] * 20_000) == [(0, 0, 20_000)]
    assert sum(n for *_, n in decontamination.tiles([1, 2] * 10_000, [2, 1, 1] * 300)) >= 0
    phrase = " ".join(f"p{k}" for k in range(10))
    index = decontamination.Benchmark.of([(k, f"{phrase} " + " ".join(f"i{k}w{j}" for j in range(10))) for k in range(20_000)])
    h = decontamination._Hashes().of("a b " + phrase + " c d")[0]
    for _ in range(50):
        assert index.search(h) == []
    assert time.process_time() - began < 30


def test_short_items_are_found_where_they_are_the_whole_text(spark):
    benchmark = spark.createDataFrame([(1, "Forty two."), (2, "forty"), (3, "...")], "item_id long, text string")
    rows = [(1, "forty TWO"), (2, "it is forty two"), (3, "Forty!"), (4, "..."), (5, None)]
    got = {(r.doc_id, r.item_id, r.coverage) for r in decontamination.contaminated(docs(spark, rows), benchmark).collect()}
    assert got == {(1, 1, 1.0), (3, 2, 1.0)}
    assert decontamination.contaminated(docs(spark, []), benchmark).count() == 0


def test_tokens_of_equal_length_do_not_collide():
    assert decontamination._hash("yxh54suv2vh9") != decontamination._hash("wfru5kkh6mze")


def test_reordered_passages_are_found_and_clean_text_is_not(spark, monkeypatch):
    item = [f"q{i}" for i in range(24)]
    bench = [(1, " ".join(item)), (2, "too short"), (3, None), (4, "")]
    rows = [(1, "x y " + " ".join(item[12:]).upper() + "! z " + ", ".join(item[:12])), (2, " ".join(f"c{i}" for i in range(100))), (3, None), (4, ""), (5, " ".join(item[:8]) + " tail"), (6, LONG + " " + " ".join(item))]
    benchmark = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs(spark, rows), benchmark).collect()}
    assert set(got) == {(1, 1), (6, 1)} and got[1, 1].coverage == 1.0 and len(got[1, 1].tiles) == 2
    d = docs(spark, rows)
    kept = decontamination.clean(d, benchmark)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert decontamination.contaminated(d, benchmark.limit(0)).count() == 0
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 40)  # more blocks give the same
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, benchmark).collect()} == set(got)
    many = decontamination.clean(d, benchmark)
    assert many.columns == d.columns and sorted(r.doc_id for r in many.collect()) == [2, 3, 4, 5]


def python_nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_a_benchmark_of_many_blocks_is_no_chain_of_python_nodes(spark, monkeypatch):
    items = [[f"i{k}w{j}" for j in range(12)] for k in range(9)]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(0, " ".join(items[0]))] * 2 + [(None, "one two"), (20, "y" * 300)]
    rows = [(k, f"a b c {' '.join(items[k % 9])} d e") for k in range(18)] + [(None, " ".join(items[3])), (30, "one TWO"), (31, "y" * 300), (32, "y" * 299), (33, None), (34, "")]
    benchmark, d = spark.createDataFrame(bench, "item_id long, text string"), docs(spark, rows)
    key = lambda r: (str(r.doc_id), str(r.item_id), r.covered, r.coverage, str(r.tiles))
    whole = sorted(map(key, decontamination.contaminated(d, benchmark).collect()))
    kept = sorted(r.doc_id for r in decontamination.clean(d, benchmark).collect())
    assert len(whole) == 16 + 2 * 3 + 1 + 1 + 1 and kept == [32, 33, 34]
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 100)
    parts = decontamination.contaminated(d, benchmark)
    assert sorted(map(key, parts.collect())) == whole and python_nodes(parts) == 0
    left = decontamination.clean(d, benchmark)
    assert sorted(r.doc_id for r in left.collect()) == kept and left.columns == d.columns and python_nodes(left) == 0
    assert decontamination.clean(docs(spark, []), benchmark).count() == 0
    assert decontamination.clean(d, benchmark.limit(0)).count() == len(rows)


# ---- packing


def check_packing(lengths, capacity=2048):
    doc, start, length, seq, offset = packing.pack(lengths, capacity)
    by_seq, by_doc = {}, {}
    for d, s, n, q, o in zip(doc, start, length, seq, offset, strict=True):
        by_seq.setdefault(q, []).append((o, n))
        by_doc.setdefault(d, []).append((s, n))
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    assert sum(sum(n for _, n in x) < capacity for x in by_seq.values()) <= 1
    for k, want in enumerate(lengths):
        at = 0
        for s, n in sorted(by_doc.get(k, [])):
            assert s == at
            at += n
        assert at == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=40))
def test_packing_is_gapless_and_full(lengths):
    check_packing(np.array(lengths, np.int64), 16)


def test_packed_ids_are_the_tokenizers(spark):
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a  b \n c", "  lead", "trail ", "x <|endoftext|>  y", "", None, "don't  \t\n stop", "中文 　 x  y \x1c z", "É à́ ß", LONG, "a", "a"]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(texts)]
    got = packing.pack_documents(docs(spark, rows).coalesce(1), P.path("byte_bpe_50k.json"), group_ids=5000).collect()
    want = Counter()
    for d, t in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = [r for r in got if r.doc_id == d and r.doc_tokens == len(ids)]
        assert {(r.start, r.length, r.ids_crc32) for r in mine} >= set() and mine
        want[len(ids)] += 1
        for r in mine:
            if d is not None:
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(n * c for n, c in want.items())
    for _, pieces in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0


# ---- classifiers


def labelled(spark, n=120):
    r = random.Random(5)
    good = [(k, " ".join(r.choice(["house", "tree", "river", "stone", "the", "of"]) for _ in range(40)), 1, 0) for k in range(n)]
    bad = [(n + k, " ".join(r.choice(["BUY!!", "NOW!!", "FREE!!"]) for _ in range(40)), 0, 0) for k in range(n)]
    toxic = [(2 * n + k, " ".join([r.choice(["house", "tree", "river"]) for _ in range(30)] + [f"idio{r.choice('abcdefgh')}{r.randrange(9)}" for _ in range(2)]), 1, 1) for k in range(n // 2)]
    rows = good + bad + toxic
    return spark.createDataFrame([(d, t) for d, t, *_ in rows], "doc_id long, text string"), spark.createDataFrame([(d, q, x) for d, _, q, x in rows], "doc_id long, quality int, toxic int")


def odd(spark):
    return docs(spark, [(1, None), (2, ""), (None, "house tree"), (3, LONG), (3, LONG)])


def test_quality_learns_and_bears_odd_rows(spark):
    d, l = labelled(spark)
    label = l.select("doc_id", F.col("quality").alias("label"))
    model = quality.train(d, label.union(label.limit(3)).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, label int")))
    new = spark.createDataFrame([(1, "stone river of the tree house the"), (2, "FREE!! BUY!! NOW!! NOW!!")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(new, model).collect()}
    assert got[1] > 0.7 and got[2] < 0.3
    assert all(0 <= r.score <= 1 for r in quality.score(odd(spark), model).collect()) and quality.score(odd(spark), model).count() == 5
    o = odd(spark)
    assert quality.accepted(o, model).columns == o.columns and quality.accepted(o.limit(0), model).count() == 0
    assert sorted(r.doc_id for r in quality.accepted(new, model).collect()) == [1]


def test_quality_without_labels_or_with_one_class(spark):
    d, l = labelled(spark, 10)
    none = quality.train(d, l.select("doc_id", F.col("quality").alias("label")).limit(0))
    assert [r.score for r in quality.score(d.limit(1), none).collect()] == [0.5]
    one = quality.train(d, l.select("doc_id", F.lit(1).alias("label")))
    assert quality.score(d.limit(1), one).first().score > 0.9


def test_toxicity_learns_families_of_words_and_finds_the_passage(spark):
    d, l = labelled(spark)
    model = toxicity.train(d, l.select("doc_id", F.col("toxic").alias("label")))
    new = spark.createDataFrame([(1, "river tree house " * 9 + "idiozz9 idioyy1 " + "tree river " * 9), (2, "river tree house " * 20), (3, "zzz yyy")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(new, model).collect()}
    assert got[1].score > 0.3 > got[2].score and got[3].score < 0.3
    assert any(p.start <= 27 < p.end for p in got[1].passages) and not got[2].passages
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd(spark), model).collect())
    assert toxicity.score(odd(spark), toxicity.Model()).count() == 5
    none = toxicity.train(d, l.select("doc_id", F.col("toxic").alias("label")).limit(0))
    assert toxicity.score(d.limit(1), none).first().score == 0.5


def test_quality_fit_is_that_of_a_plain_dual_coordinate_descent():
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(40):
        y = k % 2
        rows.append(np.unique(np.r_[rng.choice(30, 6) + (0 if y else 12), 100 + rng.choice(40, 3)]))
        labels.append(y)
    got = quality.fit(rows, np.array(labels), epochs=400)
    # dense features scaled by class log-count ratios, hinge loss solved by projected gradient on the dual
    counts = np.ones((2, quality.DIMENSIONS))
    for x, y in zip(rows, labels, strict=True):
        counts[y, x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    dense = np.zeros((40, 140))
    for k, x in enumerate(rows):
        dense[k, x] = ratio[x]
    signed = np.c_[dense, np.ones(40)] * np.where(np.array(labels) == 1, 1.0, -1.0)[:, None]
    q = signed @ signed.T
    dual, step = np.zeros(40), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20_000):
        dual = np.clip(dual - step * (q @ dual - 1), 0, 0.05)
    w = dual @ signed
    used = np.unique(np.concatenate(rows))
    touched = np.count_nonzero((dense[dual > 1e-9] != 0).any(axis=0))  # features of support vectors
    want = (0.75 * np.abs(w[:140]).sum() / touched + 0.25 * w[:140]) * ratio[:140]
    assert np.abs(got.weights[used] - want[used]).max() < 2e-3 * np.abs(want).max() and abs(got.bias - w[140]) < 2e-3


def brute_slots(text):
    words = words_of(text)
    n = len(words)
    if not n:
        return [quality._slot("empty")]
    kinds = [zlib.crc32(quality.shape(w).encode()) >> 1 for w in words]
    keys = [k * quality._MIX[0] for k in kinds] + [zlib.crc32(w.encode()) * quality._MIX[10] for w in words]
    keys += [k * m for k in kinds for x, m in zip(quality._SHARES, quality._MIX[1:], strict=False) if kinds.count(k) >= x * n]
    keys += [a * quality._MIX[5] + b * quality._MIX[6] for a, b in itertools.pairwise(kinds)]
    keys += [a * quality._MIX[7] + b * quality._MIX[8] + c * quality._MIX[9] for a, b, c in zip(kinds, kinds[1:], kinds[2:])]
    codes = [zlib.crc32(w.encode()) for w in words]
    keys += [a * quality._MIX[11] + b * quality._MIX[12] for a, b in itertools.pairwise(codes)]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    slots = {(wrap(k) >> 20) & (quality.DIMENSIONS - 1) for k in keys}
    same, new = sum(a == b for a, b in itertools.pairwise(words)), len(set(words))
    return sorted(slots | {quality._slot(repr((s, x))) for s, v in (("same", same), ("new", new)) for x in quality._SHARES if v >= x * n})


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("aB1!é \t\x1c."), max_size=60))
def test_quality_indicators_match_brute_force(text):
    assert quality.Features()(text).tolist() == brute_slots(text)


def test_quality_sample_is_bounded_in_indicators_and_ids(spark, monkeypatch):
    d, l = labelled(spark)
    label = l.select("doc_id", F.col("quality").alias("label"))
    assert quality.labelled_sample(d, label, 30).count() == 30
    places = [r.place for r in quality.labelled_sample(d, label, 30).collect()]
    assert max(places) <= sorted(r[0] for r in l.select(F.xxhash64("doc_id")).collect())[29]
    monkeypatch.setattr(quality, "SAMPLE_SLOTS", 2000)
    few = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: few.extend(rows))
    quality.train(d, label)
    assert 0 < sum(map(len, few)) <= 2000


def test_toxic_token_scores_follow_the_chain_of_priors():
    counts = {"abcdefg": (4, 1), "abcxyz": (0, 3), "ab": (1, 1)}
    scores, default = toxicity.token_log_odds(counts, 2, 8, strength=2.0, penalty=2.0)
    base = 2.5 / 11
    three = (4 + 10 * base) / (8 + 10)  # abc: both long tokens
    four = (4 + 10 * three) / (5 + 10)
    five = (4 + 10 * four) / (5 + 10)
    odds = lambda s: np.log(s / (1 - s)) - np.log(base / (1 - base)) - 2
    assert default == -2.0 and abs(scores["abc\x00"] - odds(three)) < 1e-12 and abs(scores["abcde\x00"] - odds(five)) < 1e-12
    assert abs(scores["abcdefg"] - odds((4 + 2 * five) / 7)) < 1e-12 and abs(scores["ab"] - odds((1 + 2 * base) / 4)) < 1e-12
    model = toxicity.Model(scores, default)
    assert model.token_score("(ABCDEzz!") == scores["abcde\x00"] and model.token_score("abcq") == scores["abc\x00"] and model.token_score("zz") == -2.0


def test_extreme_value_parameters_solve_their_equations():
    clean = {-2.0: 90, 1.0: 8, 2.5: 2}
    lam, k = toxicity.chance(clean, [(100, 2.0), (50, 1.0), (400, 3.0), (10, 0.0)])
    assert abs(sum(n * np.exp(lam * s) for s, n in clean.items()) / 100 - 1) < 1e-6 and lam > 0
    assert abs(k - min(1.0, 1 / np.median([100 * np.exp(-2 * lam), 50 * np.exp(-lam), 400 * np.exp(-3 * lam)]))) < 1e-12
    # and with them about one random clean text in 1/x has a segment of expectation x
    rng = np.random.default_rng(0)
    model = toxicity.Model(lam=lam, k=0.2)
    hits = sum(any(s > 8 for s, *_ in toxicity.segments(rng.choice(list(clean), 200, p=[0.9, 0.08, 0.02]))) for _ in range(300))
    assert hits <= 300 * 4 * model.k * 200 * np.exp(-lam * 8) + 20


def test_toxicity_of_an_empty_table(spark):
    assert toxicity.score(docs(spark, []), toxicity.Model()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segments_are_the_maximal_ones(values):
    scores = np.array(values, float)
    got = sorted((b, e) for _, b, e in toxicity.segments(scores))

    def brute(lo, hi):
        """Best segment (shortest, then leftmost), then both sides: the definition."""
        best = None
        for b in range(lo, hi):
            for e in range(b + 1, hi + 1):
                s = sum(values[b:e])
                if s > 0 and (best is None or s > best[0] or (s == best[0] and e - b < best[2] - best[1])):
                    best = (s, b, e)
        if best is None:
            return []
        return [(best[1], best[2]), *brute(lo, best[1]), *brute(best[2], hi)]

    total = lambda segs: sorted(sum(values[b:e]) for b, e in segs)
    assert total(got) == total(brute(0, len(values)))


# ---- WARC


def test_archives_round_trip(spark):
    big = "<p>" + LONG
    rows = [(3, "http://a/b c\r\nX: y", "same"), (1, "u", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", big), (None, "u", "alone"), (7, "u", "HTTP/1.1 é\r\n\r\nWARC/1.1"), (8, "u", "twice"), (8, "u", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "first_id": F.lit(2)})
    archives = warc.write_archives(pages, archive_bytes=200)
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[2].record_type, by[3].record_type) == ("response", "revisit", "revisit") and by[3].refers_to == 1 and by[1].refers_to is None
    assert by[5].record_type == "revisit" and by[5].refers_to == 4 and by[4].payload_bytes == 0
    assert by[6].payload_bytes == len(big) and by[None].record_type == "response"
    assert [r.record_type for r in got if r.page_id == 8] == ["response", "response"]
    for d, _, h in rows:
        if d is not None:
            assert by[d].payload_digest == warc.digest((h or "").encode()) and "=" not in by[d].payload_digest
    assert by[2].url is None and by[3].url == "http://a/b%20c%0D%0AX:%20y"
    least = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, min_revisit_bytes=5)).collect()}
    assert least[2] == "response" and least[5] == "response"
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_damage_is_noticed():
    data = warc.record(1, "u", b"payload")
    assert warc.parse(data)["payload"] == b"payload"
    for bad in (data.replace(b"payload", b"paYload"), data[:-3], data[5:]):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)

    class Stream:
        def __init__(self, data, step):
            self.data, self.step = data, step

        def read(self, _):
            out, self.data = self.data[: self.step], self.data[self.step :]
            return out

    two = warc.member(data) + warc.member(warc.record(2, "u", b"x" * 5000))
    for step in (1, 7, 1 << 20):
        assert [warc.parse(x)["page_id"] for x in warc.members(Stream(two, step))] == [1, 2]
    with pytest.raises(ValueError):
        list(warc.members(Stream(two[:-5], 64)))


# ---- exact dedup


def test_chunks_join_to_the_text_and_follow_content():
    r = random.Random(2)
    data = bytes(r.randrange(97, 123) for _ in range(60_000))
    parts = exact_dedup.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= exact_dedup.MAX_CHUNK and len(parts) > 10
    moved = exact_dedup.chunks(b"inserted " + data)
    assert len(set(moved) & set(parts)) > len(parts) * 0.8
    for small in (b"", b"a", b"ab" * 400):
        assert b"".join(exact_dedup.chunks(small)) == small


def test_exact_groups(spark, monkeypatch):
    rows = [(5, "a  b\tc"), (2, "a b c"), (9, " a b c"), (7, None), (8, ""), (1, LONG), (3, LONG.replace(" ", "\n\n")), (4, LONG + "."), (6, "dup"), (6, "dup"), (None, "a b\x0cc")]
    got = exact_dedup.exact_groups(docs(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[5].keep_id == by[2].keep_id == by[None].keep_id == 2 and by[2].group_size == 3
    assert by[2].kept and not by[5].kept and not by[None].kept and by[9].group_size == 1
    assert by[7].keep_id == by[8].keep_id == 7 and by[3].keep_id == 1 and by[4].kept
    assert [r.kept for r in got if r.doc_id == 6] == [True, True]
    assert by[5].text_sha256 == hashlib.sha256(b"a b c").hexdigest()
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    assert exact_dedup.chunk_collisions(docs(spark, rows)).count() == 0


def test_chunk_identifiers_that_collide_give_way_to_bytes(monkeypatch):
    class Weak:
        xxh3_128_digest = staticmethod(lambda c: bytes([len(c) % 2]) * 16)

    texts = ["aa bb", "cc  dd", "aa\tbb", "x", "y", None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(exact_dedup, "xxhash", Weak)
    (found,) = exact_dedup._distinct_chunks(iter([batch.select(["text"])]))
    of = {}
    for r in found.to_pylist():
        of.setdefault(r["digest"], set()).add(r["chunk"])
    bad = frozenset(d for d, c in of.items() if len(c) > 1)
    assert bad
    recipes = [next(exact_dedup._recipes(b)(iter([batch])))["recipe"].to_pylist() for b in (frozenset(), bad)]
    assert recipes[0][0] == recipes[0][1]  # without verification these would be equal
    assert [[a == b for b in recipes[1]] for a in recipes[1]] == [[exact_dedup.normalise(a) == exact_dedup.normalise(b) for b in texts] for a in texts]


# ---- SimHash


def brute_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "Two WORDS", "a b c d", "a b c d e A B C D E", "É é ÀÂ x y", LONG[:4000]])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("members", [simhash.MEMBERS, 40, 7])
def test_links_lose_nothing(spark, members):
    r = random.Random(4)
    near = [r.getrandbits(64) for _ in range(60)]
    for f in list(near):
        for bits in (1, 2, 3, 4, 5):
            g = f
            for b in r.sample(range(64), bits):
                g ^= 1 << b
            near.append(g)
    centre = r.getrandbits(64)
    near += [centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)] + [0]
    fps = sorted(set(near))
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    signed = [int(np.array(f, np.uint64).astype(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.id: r.root for r in graph.components(simhash.links(nodes, members=members)).collect()}
    assert len(simhash.crowded_anchors(nodes, members)[0]) > 0 or members > 40
    groups = {}
    for k, s in enumerate(signed):
        groups.setdefault(find(k), set()).add(s)
    got = {}
    for s in signed:
        got.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_anchor_bits_hold_every_anchor():
    fps = np.array([0, -1, 1 << 62, -(1 << 63)], np.int64)
    keys, fp, home = simhash._replicas(fps, *simhash._code_tables())
    assert keys.min() >= 0 and keys.max() < 1 << simhash.ANCHOR_BITS and home.sum() == 3 * len(fps) and len(keys) == len(fp)


def test_near_groups_of_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(400))
    rows = [(4, text), (2, text + " end"), (9, text), (7, None), (3, ""), (5, LONG), (None, LONG), (6, "x"), (6, "x")]
    got = simhash.near_groups(docs(spark, rows)).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows) and by[7] == by[3] == 3 and by[9] == by[4] and by[None] == by[5] == 5 and by[6] == 6
    assert simhash.near_groups(docs(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.id: r.root for r in graph.components(edges).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[101] == 100


@pytest.mark.parametrize("shuffled", [False, True])
def test_components_of_a_path_whose_small_labels_travel_slowly(spark, shuffled):
    order = random.Random(8).sample(range(1, 301), 300) if shuffled else [1, *range(100, 1, -1)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(list(itertools.pairwise(order)), "u long, v long")).collect()}
    assert got == dict.fromkeys(order, 1)


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_filter, corpus_pipeline.near_filter])
def test_dedup_stages_keep_one_row_a_group(spark, stage):
    a, b, c = (" ".join(f"{p}{i}" for i in range(300)) for p in "abc")
    rows = [(3, a), (5, a), (5, b), (6, c), (6, c), (None, c), (None, "n"), (None, "n")]
    got = stage(spark, docs(spark, rows).drop("_row"), "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(3, a), (5, b), (6, c), (None, "n")], key=repr)
    assert "_row" not in got.columns and "doc_id" in got.columns


STAGE_ROWS = [(9001, None), (9002, ""), (9002, ""), (None, "house tree river stone"), (9004, "BUY!! " * 60), (9005, LONG)]


def stage_dir(spark, tmp_path):
    """Labels, benchmark and documents (with clashing columns) as the pipeline reads them."""
    d, l = labelled(spark, 40)
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(24))), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    l.write.parquet(f"{tmp_path}/labels.parquet")
    return d, l


def test_stages_bear_odd_rows_and_empty_tables(spark, tmp_path):
    d, _ = stage_dir(spark, tmp_path)
    clash = {n: F.lit(1) for n in ("label", "fp", "root", "key", "slots", "place", "rank")}
    odd_rows = docs(spark, STAGE_ROWS).drop("_row").withColumns(clash)
    whole = d.withColumns({n: c for n, c in clash.items()})
    for column in odd_rows.columns:
        if column not in whole.columns:
            whole = whole.withColumn(column, F.lit(None).cast(dict(odd_rows.dtypes)[column]))
    whole = whole.select(odd_rows.columns).unionByName(odd_rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, whole, str(tmp_path))
        assert got.columns == whole.columns and stage(spark, whole.limit(0), str(tmp_path)).count() == 0, name
    kept = corpus_pipeline.quality_filter(spark, whole, str(tmp_path))
    assert kept.where("doc_id = 9004").count() == 0 and kept.where("doc_id < 40").count() >= 40
    pieces = corpus_pipeline.packed(spark, odd_rows, str(tmp_path))
    assert pieces.where("doc_id = 9002").agg(F.sum("length")).first()[0] == 2 and corpus_pipeline.packed(spark, whole.limit(0), str(tmp_path)).count() == 0


def test_pipeline_matches_its_stages_by_brute_force(spark, tmp_path):
    d, _ = stage_dir(spark, tmp_path)
    item = " ".join(f"q{i}" for i in range(24))
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(r.doc_id, r.text) for r in d.collect()] + [(9001, base), (9002, base.replace(" ", "\n")), (9003, base + " more"), (9004, "the stone " + item), (9005, "BUY!! NOW!! FREE!! " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    all_docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.accepted(all_docs, quality.train(all_docs, labels)).collect()}
    left = {k: " ".join(WORD.findall(t)) for k, t in sorted(rows) if k in good}
    left = {k: t for k, t in left.items() if k == min(j for j, u in left.items() if u == t)}
    prints = {k: brute_fingerprint(t) for k, t in left.items()}
    root = {k: k for k in left}
    for _ in left:
        for a, b in itertools.combinations(left, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[a] = root[b] = min(root[a], root[b])
    left = {k: t for k, t in left.items() if root[k] == k and item not in t}
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = dict(rows)
    want = {k: len(tk.encode(texts[k], add_special_tokens=False).ids) + 1 for k in left}
    assert {r.doc_id: r.doc_tokens for r in got} == want and sum(r.length for r in got) == sum(want.values())
    assert 9001 in want and not {9002, 9003, 9004, 9005} & set(want)


# ---- language model


def brute_scores(model, counts, text):
    """log10 probability of a text, token by token, from the model's parameters."""
    v, flat = model.vocabulary, model.flat.astype(float)
    lm, c, h = language_model, v.classes, max(v.heads, 1)
    rows, flat = flat[: 3 * lm.ROWS * c].reshape(-1, c), flat[3 * lm.ROWS * c :]
    bias, flat = flat[:c], flat[c:]
    inner, inner_bias = flat[: c * h * lm.WIDTH].reshape(-1, lm.WIDTH), flat[c * h * lm.WIDTH :].reshape(-1, lm.WIDTH)
    words = [*WORD.findall("".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")), lm.END]
    klass, own = [], []
    for w in words:
        i = v.hot.get(w)
        klass.append(int(v.klass[i]) if i is not None else v.heads + v.topic_of(w))
        own.append(i if klass[-1] < v.heads else lm.HEAD + klass[-1])
    total = 0.0
    for k, w in enumerate(words):
        one, two = own[k - 1] if k else -1, own[k - 2] if k > 1 else -1
        slot = lambda x: (x * 0x9E3779B1 >> 11) & (lm.ROWS - 1)
        x = bias + rows[slot(one + 7)] + rows[lm.ROWS + slot(two + 77)] + rows[2 * lm.ROWS + slot((one + 7) * 40503 + two * 69069 + 5)]
        p = np.exp(x - x.max())
        target = c - 1 if k and words[k - 1] == w else klass[k]
        total += np.log10(p[target] / p.sum())
        if target < v.heads:
            before = klass[k - 1] if k else c - 1
            y = inner[before * h + target, : v.sizes[target]] + inner_bias[target, : v.sizes[target]]
            q = np.exp(y - y.max())
            total += np.log10(q[v.member[v.hot[w]]] / q.sum())
        elif target < c - 1:
            total += np.log10(counts.get(w, 0) + 1) - v.tail_total[target - v.heads]
    return total


def test_language_model_scores_match_brute_force(spark):
    r = random.Random(11)
    rare = [f"rare{i}" for i in range(30_000)]
    common = [f"c{i}" for i in range(60)]
    rows = [(k, " ".join(r.choice(common) if r.random() < 0.8 else r.choice(rare) for _ in range(200))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "new New c1 c1 c1 rare1 never-seen c2"), (None, "C3 é é"), (903, "c1")]
    d = docs(spark, rows)
    training = d.where("doc_id < 140")
    counts = table(language_model.word_counts(training), "counts")
    model = language_model.train(training, counts)
    known = {x["unit"]: x["n"] for x in counts.collect()}
    assert len(known) > language_model.HEAD  # some words have their share of a topic only
    got = Counter((x.doc_id, round(x.score, 3)) for x in language_model.score(d, model, counts).collect())
    want = [(k, brute_scores(model, known, t)) for k, t in rows]
    for k, score in want:
        assert any(got[k, round(score + e, 3)] for e in (-0.001, 0, 0.001)), (k, score)
    assert got.total() == len(rows)


def test_words_of_one_count_only(spark):
    """More distinct words than the hot ones, all as frequent: none is hot."""
    d = docs(spark, [(1, "a b c d"), (2, None)])
    counts = table(language_model.word_counts(d.where("doc_id = 1")), "counts")
    assert most_frequent(counts, 4).num_rows == 0 and most_frequent(counts, 5).num_rows == 5
    assert language_model.topics(np.zeros((0, 0)), np.zeros(0)).tolist() == []


def test_most_frequent_takes_whole_grades(spark):
    counts = spark.createDataFrame([(f"u{k:03}", n) for k, n in enumerate([5] * 10 + [3] * 20 + [1] * 40 + [5000, 5001, 90_000, 1 << 40])], "unit string, n long")
    assert [(r["unit"], r["n"]) for r in most_frequent(counts, 20).to_pylist()] == [("u073", 1 << 40), ("u072", 90_000), ("u071", 5001), ("u070", 5000)] + [(f"u{k:03}", 5) for k in range(10)]
    assert most_frequent(counts, 34).num_rows == 34 and most_frequent(counts, 33).num_rows == 14 and most_frequent(counts.limit(0), 9).num_rows == 0


def test_language_model_counts_exactly_and_beats_unigrams(spark):
    r = random.Random(6)
    pools = [[f"{p}{i}" for i in range(40)] for p in ("xa", "yb")]
    rows = [(k, " ".join(r.choice(pools[k % 2]) for _ in range(120))) for k in range(120)] + [(500, None), (501, ""), (502, "New NEW new unseen"), (502, "New NEW new unseen"), (None, "xa1 é")]
    d = docs(spark, rows)
    training = d.where("doc_id < 100")
    counts = table(language_model.word_counts(training), "counts")
    model = language_model.train(training, counts)
    got = language_model.score(d, model, counts).collect()
    c = Counter(w for k, t in rows if k is not None and k < 100 for w in [*WORD.findall(t), "<end>"])
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.words) == (n, v) and len(got) == len(rows)
    low = lambda t: "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")
    want = Counter()
    for _, t in rows:
        w = [*WORD.findall(low(t)), "<end>"]
        want[len(w), sum(c[x] > 0 for x in w), round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((g.n_tokens, g.n_known, round(g.base_score, 6)) for g in got) == want
    held = [g for g in got if g.doc_id is not None and 100 <= g.doc_id < 120]
    assert sum(g.score for g in held) > sum(g.base_score for g in held) and all(g.score < 0 for g in got)


def test_language_model_without_training_rows(spark):
    d = docs(spark, [(1, "a b"), (2, None)])
    counts = table(language_model.word_counts(d.limit(0)), "counts")
    model = language_model.train(d.limit(0), counts)
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in language_model.score(d, model, counts).collect()}
    assert got == {1: (3, 0), 2: (1, 0)}
    assert language_model.score(d.limit(0), model, counts).count() == 0


def test_class_probabilities_sum_to_one():
    words = [language_model.END] + [f"w{i}" for i in range(300)]
    v = language_model.vocabulary(words, np.arange(301, 0, -1).astype(float), np.arange(301) % language_model.TOPICS)
    net = language_model.Net(v)
    rng = np.random.default_rng(0)
    net.flat += rng.normal(0, 0.3, len(net.flat)).astype(np.float32)
    sums = 0.0
    for w in words[1:]:
        t = language_model.encode(language_model.Coder(v), [["w5", w, language_model.END]])
        if t.klass[1] < v.heads:
            sums += 10 ** language_model.log_probabilities(net, t)[1]
    t = language_model.encode(language_model.Coder(v), [["w5", "unknown!", language_model.END]])
    assert 0 < sums < 1 and v.heads <= t.klass[1] < v.classes - 1


def test_words_up_to_4096_have_their_own_statistics_and_company_reaches_four_words():
    words = [language_model.END] + [f"w{i}" for i in range(4095)]
    v = language_model.vocabulary(words, np.arange(4096, 0, -1).astype(float), np.arange(4096) % language_model.TOPICS)
    assert (v.klass < v.heads).all() and len(set(zip(v.klass.tolist(), v.member.tolist(), strict=True))) == 4096
    t = language_model.encode(language_model.Coder(v), [["w3000", "w1"], ["w3008", "w1"]])  # of one topic
    assert t.features[1].tolist() != t.features[3].tolist()
    held = type("Held", (), {"value": language_model._Index(["a", "b"])})
    batch = pa.RecordBatch.from_arrays([pa.array(["a x x x b"])], ["text"])
    (sums,) = language_model._company(held, 2)([batch])
    near = np.frombuffer(sums["data"][0].as_py(), np.float32).reshape(3, -1)
    assert near[0, 1] == near[1, 0] == 1


# ---- token counts


def test_token_counts_are_the_librarys(spark):
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [None, "", "  ", "Hello, WORLD's 123 don't!!", "<|endoftext|> x <|startoftext|>y <|ENDOFTEXT|>", "é à́ İstanbul ΣΑΣ 中文。x y", "a\x1cb\x85c", LONG, "x" * 5000, "👍🏽 ok", "ǅ ªº ²³ ¼"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "null id")]
    for hot in (1 << 17, 3):  # nearly all joined, or nearly all broadcast
        got = token_counts.count_tokens(docs(spark, rows), P.path("word_bpe_49k.json"), hot).collect()
        want = Counter((d, len((t or "").encode()), len(tk.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(docs(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_words_are_cut_at_ascii_white_space_only():
    assert words_of("a b\x1cc \t\n\x0b\x0c\rd") == ["a b\x1cc", "d"] and words_of(None) == []

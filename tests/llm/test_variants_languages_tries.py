"""Spelling variants, language identification and the prefix trie against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import common, language_id, language_model, prefix_trie, spelling, token_counts

CLASHING = ("word", "n", "key", "way", "band", "m0", "run", "h", "form", "letters", "of", "rate", "place", "part", "score", "block", "row", "depth", "owner", "base", "turns", "path")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


# ---- spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    form, near = {}, {}
    for w in n:
        near[w] = [x for x in n if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def misspelt():
    r = random.Random(5)
    letters = "abcdeé×÷Àß"
    words = ["".join(r.choice(letters) for _ in range(r.randrange(6, 10))) for _ in range(12)]
    texts = []
    for w in words:
        for k in range(40):
            i = r.randrange(len(w))
            x = r.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]])
            texts.append(x if k % 3 else x.upper().replace("É", "é").replace("SS", "ß") if x.isascii() else x)
    r.shuffle(texts)
    rows = [(k, " ".join(texts[8 * k : 8 * k + 8])) for k in range(60)]
    chain = ["aaaaaaa"] * 4 + ["aaaaaab"] * 35 + ["aaaaabb"] * 180
    return [*rows, (None, "aaaaaaa, AAAAAAA"), (61, None), (62, ""), (63, "12 34 _"), (5, rows[5][1]), (5, rows[5][1]), (64, " ".join(chain) + " x" * 5000), (-7, "tie1 " + "tieaaa " * 50 + "tiebbb " * 50 + "tieaab " * 9)]


def test_variants_match_brute_force(spark):
    rows = misspelt()
    got = spelling.variants(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = brute_variants(rows)
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want
    assert any(f and root != f for _, f, root, *_ in want)  # a chain of forms


@pytest.mark.parametrize("letters", ["ab", "abcé", "acfilo"])
def test_near_pairs_lose_and_repeat_nothing(spark, letters):
    r = random.Random(9)
    words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(6, 9))) for _ in range(180)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = Counter(frozenset((p.word, p.near)) for p in spelling.near_pairs(df).collect())
    assert got == Counter(frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))


def test_every_letter_has_its_bit(spark):
    assert sorted("".join(spelling.BAND_LETTERS)) == sorted([chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xC0, 0x100)])
    row = spark.createDataFrame([("abba" + "".join(spelling.BAND_LETTERS),)], "word string").select(*[spelling.parity_mask(F.col("word"), b) for b in range(3)]).first()
    assert [bin(m).count("1") for m in row] == [len(x) for x in spelling.BAND_LETTERS]


def test_variants_of_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b"), (None, "")], "doc_id long, text string")).count() == 0


# ---- language


def speech(r, k, words):
    syllables = [["the", "ing", "wha", "oth"], ["ein", "sch", "lich", "ü"], ["ció", "ñar", "los", "que"]][k]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def network():
    r = random.Random(1)
    texts = [(speech(r, k % 3, 60), k % 3) for k in range(360)]
    windows = np.frombuffer(b"".join(t.encode()[: language_id.WINDOW].ljust(language_id.SPAN, b"\0") for t, _ in texts), np.uint8).reshape(-1, language_id.SPAN)
    return language_id.fit(windows, np.array([k for _, k in texts]), ["en", "de", "es"])


def test_windows_are_scored_as_by_plain_convolution(network):
    r = np.random.default_rng(3)
    windows = r.integers(0, 256, (3, language_id.SPAN)).astype(np.uint8)
    pooled = []
    for w, f in zip(language_id.WIDTHS, network.filters, strict=True):
        x = network.embedding[windows]
        pooled.append(np.array([[max(float((x[i, p : p + w] * f[:, :, j]).sum()) for p in range(language_id.WINDOW)) for j in range(language_id.FILTERS)] for i in range(3)]))
    hidden = np.maximum(np.concatenate(pooled, axis=1) + network.bias, 0)
    assert np.allclose(network.pooled(windows), hidden, atol=1e-4)
    e = np.exp(hidden @ network.out + network.out_bias)
    assert np.allclose(network.probabilities(windows), e / e.sum(axis=1, keepdims=True), atol=1e-4)


def test_gradients_are_those_of_the_loss(network):
    r = np.random.default_rng(4)
    windows, labels = r.integers(97, 123, (5, language_id.SPAN)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, found = language_id.gradients(network, windows, labels)
    parameters = [network.embedding, *network.filters, network.bias, network.out, network.out_bias]
    for x, g in zip(parameters, found, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, losses = x[at], []
        for d in (1e-6, -1e-6):
            x[at] = was + d
            losses.append(language_id.gradients(network, windows, labels)[0])
        x[at] = was
        assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_texts_are_the_weighted_mean_of_all_their_windows(network):
    r = random.Random(8)
    texts = [speech(r, 0, 4).encode(), b"", (speech(r, 1, 40) + " " + speech(r, 2, 400)).encode(), b"x" * language_id.WINDOW, b"y" * (language_id.WINDOW * 70 + 1)]
    got = network.texts(texts)
    for text, p in zip(texts, got, strict=True):
        want, size = np.zeros(3), language_id.WINDOW
        for at in range(0, len(text), size):
            part = text[at : at + size]
            one = np.frombuffer(part.ljust(language_id.SPAN, b"\0"), np.uint8)[None]
            want += network.probabilities(one)[0] * len(part) / len(text)
        assert np.allclose(p, want, atol=1e-5)
    assert got[2].argmax() == 2  # the longer part decides, though it comes second


def test_languages_are_learned_and_odd_rows_borne(spark):
    r = random.Random(2)
    rows = [(k, speech(r, k % 3, r.randrange(1, 120)), ["en", "de", "es"][k % 3]) for k in range(600)]
    df = clashing(spark.createDataFrame([*rows, (700, "the", None), (701, None, "en"), (702, "12 !", "fr")], "doc_id long, text string, lang string"))
    net = language_id.train(df.where("doc_id % 3 <> 1 OR doc_id >= 600 OR doc_id % 2 = 0"))
    assert net.languages == ["de", "en", "es"]  # a language without a letter teaches nothing
    odd = [(None, "the othing whathe"), (801, None, ), (802, ""), (803, " \n1!"), (804, rows[1][1]), (804, rows[1][1]), (805, "lich ein schein " * 20_000)]
    asked = clashing(spark.createDataFrame([(d, *(t or (None,))) for d, *t in odd], "doc_id long, text string")).unionByName(df, allowMissingColumns=True)
    got = {(x.doc_id, x.lang_pred): x.score for x in language_id.predict(asked, net).collect()}
    assert (None, "en") in got and (805, "de") in got and all(got[d, "und"] == 0 for d in (801, 802, 803, 701, 702))
    held = [(d, lang) for d, _, lang in rows if d % 3 == 1 and d % 2]
    assert sum((d, lang) in got for d, lang in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())


def test_languages_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    net = language_id.train(empty)
    assert net.languages == [] and language_id.predict(empty, net).count() == 0
    got = language_id.predict(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), net).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_the_sample_is_bounded_even_if_one_row_repeats(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    assert language_id.labelled_sample(df, 50).num_rows <= 50


# ---- prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, built = defaultdict(list), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children, out, totals = defaultdict(set), [], {}
    for node in members:
        if node:
            children[node[:-1]].add(node)
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children[node]]
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        totals[node] = (sum(x for x, _ in below) or 1, saved + sum(x for _, x in below))
        ends = sorted(c for c in members[node] if len(built[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), *totals[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks():
    r = random.Random(6)
    rows = []
    for c in [*range(0, 40), *range(100, 160), *range(305, 330), 10**12, 10**12 + 1]:
        first = r.choice(["hello", "hi", "copy"])
        turns = [("user", "same"), ("assistant", "copy")] if first == "copy" else [("user", first), *[(r.choice(["user", "assistant"]), r.choice("ab中\U0001f600")) for _ in range(r.randrange(0, 7))]]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    rows += [(400, k, "user", f"t{k}") for k in range(30)] + [(401, k, "user", f"t{k}") for k in range(29)]
    rows += [(500, None, "user", "null first"), (500, 0, None, None), (500, 0, "", ""), (500, 0, "", ""), (None, 0, "user", "lost"), (501, 3, "a", "tie"), (501, 3, "b", "tie"), (502, 9, "long", "x" * 50_000)]
    return rows


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block_rows", [20_000, 17, 3, 1])
def test_trie_matches_brute_force(spark, block_rows):
    rows = talks()
    got = prefix_trie.prefix_trie(clashing(spark.createDataFrame(rows, CONVERSATION)), block_rows).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "a", "b")], [(7, 0, "user", "gone")], [(7, 0, "u", "x"), (11, 0, "u", "x")], [(3, 0, "u", "same")] + [(k, 0, "u", "same") for k in range(1000, 1090)]])
def test_trie_of_few_and_of_equal_conversations(spark, rows):
    for block_rows in (20_000, 2):
        got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATION), block_rows).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40))
def test_nearest_smaller_blocks(values):
    values = [-1, *values]
    numbers = [3 * k + 1 for k in range(len(values))]
    minima = prefix_trie.Minima(numbers, values)
    for k in range(1, len(values)):
        for depth in range(5):
            assert minima.before(numbers[k], depth) == numbers[max(j for j in range(k) if values[j] < depth)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=9), st.lists(st.integers(0, 2), max_size=9))
def test_common_prefixes(a, b):
    path = lambda x: b"".join(bytes([v]) * prefix_trie.DIGEST for v in x)
    want = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert prefix_trie._common(path(a), path(b)) == want


# ---- broadcasts are bounded in bytes


def test_very_long_words_are_joined_not_broadcast(spark, monkeypatch):
    sent = []
    real = common.most_frequent

    def watched(counts, most, longest=None):
        found = real(counts, most, longest)
        sent.extend(found["unit"].to_pylist())
        return found

    monkeypatch.setattr(token_counts, "most_frequent", watched)
    monkeypatch.setattr(language_model, "most_frequent", watched)
    long = ["x" * 100_000, "é" * 50_000, "y" * 64]
    rows = [(k, f"some words {long[k % 3]} of {long[0]}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path).collect()}
    assert got == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in rows}
    counts = common.table(language_model.word_counts(df), "counts")
    scored = language_model.score(df, language_model.train(df, counts), counts).collect()
    assert all(r.n_tokens == r.n_known == 6 for r in scored) and sent and max(len(u.encode()) for u in sent) <= common.LONGEST_UNIT

"""Spelling variants: words one edit apart, found by equal bands of letter-parity masks.

A mask has a bit per letter, set where the letter occurs an odd number of
times. One inserted or deleted letter flips one bit, a replaced one flips two,
so of a mask's three bands (letters by code point modulo three) a replacement
leaves at least one as it is, an insertion or deletion two. Words meet where
such bands are equal and their lengths fit. As short words have few different
bands, a band is met together with what an edit elsewhere also leaves alone:
the places of the band's letters, and the half of the word without the edit;
for insertions, the order of the two bands' letters. None of this drops a
pair. Masks that differ in the wrong number of bits are passed over, and edit
distance verifies the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The letters of words; only A-Z of them are lowered.
LETTERS = "A-Za-zÀ-ÿ"
BANDS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CODES = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
#: Letters of each band, in order; a letter's place in its band is its bit.
BAND_LETTERS = ["".join(chr(c) for c in _CODES if c % BANDS == b) for b in range(BANDS)]
PAIR = ("word", "n", "near", "near_n")


def noisy_words(docs: DataFrame, every: int = 199) -> DataFrame:
    """word of every run of letters of documents (doc_id, text), A-Z lowered.

    Where ``every`` divides h, the CRC-32 of ``<doc_id>:<run>``, the code point
    at h modulo length is left out. A null id counts as empty; null texts have
    no words.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return low.withColumn("h", h).select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def frequent_words(words: DataFrame, least_length: int = 6, least_n: int = 5) -> DataFrame:
    """word, n of words with enough code points and occurrences, counted map-side first."""
    long = words.where(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def parity_mask(word: Column, band: int) -> Column:
    """Parities of a band's letters in a word, as bits of a long."""
    own = F.split(F.regexp_replace(word, f"[^{BAND_LETTERS[band]}]", ""), "")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.instr(F.lit(BAND_LETTERS[band]), c) - 1)
    return F.aggregate(own, F.lit(0).cast("long"), lambda mask, c: F.when(c == "", mask).otherwise(mask.bitwiseXOR(bit(c))))


def _banded(words: DataFrame) -> DataFrame:
    """A row per word and meeting place: key (a hash), way, band, and word, n, masks.

    Ways: 0 and 1 meet for a replacement in the right and in the left half; 2
    (as the shorter word) and 3 (as the longer) for an insertion into a band.
    """
    w, size = F.col("word"), F.char_length("word")
    half = F.floor(size / 2).cast("int")
    places = []
    for b in range(BANDS):
        shown = F.regexp_replace(w, f"[^{BAND_LETTERS[b]}]", ".")
        rest = F.regexp_replace(w, f"[{BAND_LETTERS[b]}]", "")
        for way, kept in ((0, F.substring(w, F.lit(1), half)), (1, F.substring(w, half + 1, size))):
            places.append(F.struct(F.lit(way).alias("way"), F.lit(b).alias("band"), F.xxhash64(F.lit(2 * b + way), F.col(f"m{b}"), shown, kept).alias("key")))
        others = [F.col(f"m{o}") for o in range(BANDS) if o != b]
        for way, longer in ((2, size + 1), (3, size)):
            places.append(F.struct(F.lit(way).alias("way"), F.lit(b).alias("band"), F.xxhash64(F.lit(2 * BANDS + b), *others, rest, longer).alias("key")))
    return words.select("word", "n", *[f"m{b}" for b in range(BANDS)], F.explode(F.array(*places)).alias("p")).select("p.key", "p.way", "p.band", "word", "n", *[f"m{b}" for b in range(BANDS)])


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words (word, n; no word twice) one edit apart, once.

    Both sides are plain exchanges, so a crowded key is split over tasks. A
    pair that has two equal bands counts where the first of them meets.
    """
    masked = words.withColumns({f"m{b}": parity_mask(F.col("word"), b) for b in range(BANDS)})
    rows = _banded(masked)
    a = rows.where("way <> 3").select(*[F.col(c).alias("a_" + c) for c in rows.columns])
    b = rows.where("way <> 2").select(*[F.col(c).alias("b_" + c) for c in rows.columns])
    flipped = [F.col(f"a_m{k}").bitwiseXOR(F.col(f"b_m{k}")) for k in range(BANDS)]
    bits = reduce(Column.__add__, [F.bit_count(x) for x in flipped])
    before = lambda k: reduce(Column.__and__, [x != 0 for x in flipped[:k]], F.lit(True))
    first = reduce(Column.__or__, [(F.col("a_band") == k) & (flipped[k] == 0) & before(k) for k in range(BANDS)])
    own = reduce(Column.__or__, [(F.col("a_band") == k) & (flipped[k] != 0) for k in range(BANDS)])
    size = F.char_length("a_word")
    half = F.floor(size / 2).cast("int")
    same_half = F.when(F.col("a_way") == 0, F.substring("a_word", F.lit(1), half) == F.substring("b_word", F.lit(1), half)).otherwise(F.substring("a_word", half + 1, size) == F.substring("b_word", half + 1, size))
    replaced = (F.col("a_way") == F.col("b_way")) & (bits == 2) & first & (F.col("a_word") < F.col("b_word")) & (F.char_length("b_word") == size) & same_half
    added = (F.col("a_way") == 2) & (F.col("b_way") == 3) & (bits == 1) & own & (F.char_length("b_word") == size + 1)
    verified = F.when(replaced | added, F.levenshtein("a_word", "b_word", 1) == 1).otherwise(False)  # costly checks last
    met = a.hint("merge").join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_band") == F.col("b_band")) & verified)
    return met.select("a_word", "a_n", "b_word", "b_n").toDF(*PAIR)


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n: a word's most frequent near word, where it is ``ratio`` times as frequent.

    Ties go to the smaller word in code-point order.
    """
    ways = F.array(F.struct(*PAIR), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    both = pairs.select(F.inline(ways))
    best = F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("best")
    known = both.groupBy(F.col("word").alias("known")).agg(F.count(F.lit(1)).alias("n_near"), best)
    held = -F.col("best.low") >= F.col("n") * ratio
    joined = words.join(known, F.col("word") == F.col("known"), "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, F.col("best.near")).alias("form"), F.when(held, -F.col("best.low")).cast("long").alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words with a form: where following forms ends.

    Counts rise ``ratio``-fold with each form, so chains are short and have no
    loop; each round doubles the steps and is a written table.
    """
    at = table(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("onward"))
        moved = table(at.join(on, at["root"] == on["via"], "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("via").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all frequent words of documents (doc_id, text).

    Null and empty texts have no words, and very long ones are read whole;
    repeated rows count as often as they stand; ties go to the smaller word in
    code-point order; an empty table has no words; extra columns are ignored.
    """
    words = table(frequent_words(noisy_words(docs.select("doc_id", "text"))), "words")
    formed = table(forms(words, near_pairs(words)), "formed")
    ends = roots(formed).select(F.col("word").alias("start"), "root")
    rows = formed.join(ends, formed["word"] == ends["start"], "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

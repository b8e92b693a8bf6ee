"""Full-text search: postings as tables, BM25 as an aggregate, phrases and windows by positions.

The index is a derived table (id, term, tf, positions); its statistics cover
everything indexed, also what a query may not show. All terms of a query must
occur.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def query_tokens(query: str) -> list[str]:
    """Tokens of a free-text query, in order: lower case without Latin marks, cut at all but letters and digits."""
    return re.findall(r"[^\W_]+", query.lower().translate(X.UNMARKED))


def query_terms(query: str) -> list[str]:
    """The different tokens of a query."""
    return list(dict.fromkeys(query_tokens(query)))


def holds_phrase(text: Column, query: str) -> Column:
    """Whether a query's tokens stand in the text in order, next to each other; false for fewer than two."""
    tokens = query_tokens(query)
    if len(tokens) < 2:
        return F.lit(False)
    return F.concat(F.lit(" "), F.array_join(X.index_tokens(text), " "), F.lit(" ")).contains(f" {' '.join(tokens)} ")


def postings(rows: DataFrame, key: str, *texts: str) -> DataFrame:
    """key, term, tf over all given columns of a row."""
    tokens = F.concat(*[X.index_tokens(F.col(t)) for t in texts])
    return rows.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(rows: DataFrame, key: str, texts: tuple[str, ...], query: str) -> DataFrame:
    """key, bm25 of the rows that hold every term of the query.

    Only the query's terms are looked for: each row counts them in place, so
    no postings are shuffled. Totals are one aggregate over all rows.
    """
    terms = query_terms(query)
    tokens = rows.select(key, F.concat(*[X.index_tokens(F.col(t)) for t in texts]).alias("t"))
    times = lambda x: F.size(F.filter("t", lambda w: w == x))
    counted = tokens.select(key, F.size("t").alias("len"), *[times(x).alias(f"f{k}") for k, x in enumerate(terms)])
    if not terms:
        return counted.where(F.lit(False)).select(key, F.lit(0.0).alias("bm25"))
    totals = counted.agg(F.struct(F.count(F.lit(1)).alias("n_rows"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(terms))]))
    joined = counted.where(" AND ".join(f"f{k} > 0" for k in range(len(terms)))).withColumn("all", totals.scalar())
    return joined.select(key, _score(len(terms), lambda k: F.col(f"all.n{k}"), F.col("all.n_rows"), F.col("all.avg_len")).alias("bm25"))


def _score(n_terms: int, df: Callable[[int], Column], n_rows: Column, avg_len: Column) -> Column:
    """BM25 of a row with len and the times of each term (f0, f1, ...)."""

    def part(k: int) -> Column:
        f, n = F.col(f"f{k}"), df(k)
        idf = F.log((n_rows - n + 0.5) / (n + 0.5))
        weight = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
        return weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / avg_len))

    return sum((part(k) for k in range(1, n_terms)), part(0))


def _deltas(positions: Column) -> Column:
    """Rising numbers as the first one and the steps to the next ones, which are small."""
    return F.zip_with(positions, F.concat(F.array(F.lit(0)), F.slice(positions, F.lit(1), F.size(positions) - 1)), lambda a, b: a - b)


def _rising(deltas: Column) -> Column:
    """The numbers again."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(deltas, start, lambda s, d: F.struct((s["at"] + d).alias("at"), F.concat(s["all"], F.array(s["at"] + d)).alias("all")), lambda s: s["all"])


@dataclass
class Index:
    """A stored index: postings (keys, len, term, tf, positions), lengths (keys, len) and totals (n_rows, sum_len; one row).

    Postings carry the length of their row, so a search reads its terms'
    postings and one row of totals, and nothing else. Positions are those of a
    term's tokens in its row, from 0, as first position and steps. A changed
    row is taken out by some of its keys and put in anew.
    """

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame
    keys: tuple[str, ...]

    @classmethod
    def build(cls, rows: DataFrame, keys: tuple[str, ...], *texts: str, order: str | None = None) -> Index:
        """Of rows; texts of several rows with the same keys count as one text, in the order of a column.

        A place is left free between the texts of a row and between rows, so
        that no phrase reaches over.
        """
        own = [X.index_tokens(F.col(t)) for t in texts]
        gap = F.array(F.lit(None).cast("string"))
        joined = F.concat(*[x for t in own for x in (t, gap)])
        tokens = rows.select(*keys, joined.alias("t"), *([F.col(order).alias("_order")] if order else []))
        first = F.lit(0)
        if order:
            before = Window.partitionBy(*keys).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
            tokens = tokens.withColumn("_first", F.coalesce(F.sum(F.size("t")).over(before), F.lit(0)))
            first = F.col("_first")
        lengths_ = tokens.groupBy(*keys).agg(F.sum(F.size("t") - len(texts)).alias("len"))
        each = tokens.select(*keys, first.alias("_from"), F.posexplode("t").alias("_at", "term")).where("term IS NOT NULL")
        times = each.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"), _deltas(F.sort_array(F.collect_list((F.col("_from") + F.col("_at")).cast("int")))).alias("positions"))
        return cls._of(times.join(lengths_, list(keys)).select(*keys, "len", "term", "tf", "positions"), lengths_, keys)

    @classmethod
    def _of(cls, postings_: DataFrame, lengths_: DataFrame, keys: tuple[str, ...]) -> Index:
        return cls(postings_, lengths_, totals_of(lengths_), keys)

    def without(self, gone: DataFrame) -> Index:
        """The index without the rows whose keys are in ``gone``, a table of one or more of them."""
        left = lambda df: df.join(gone, gone.columns, "left_anti").select(*df.columns)
        return self._of(left(self.postings), left(self.lengths), self.keys)

    def merged(self, other: Index) -> Index:
        """Both indexes' rows, which must not share keys."""
        return self._of(self.postings.unionByName(other.postings), self.lengths.unionByName(other.lengths), self.keys)

    def refreshed(self, rows: DataFrame, *texts: str) -> Index:
        """The index with these rows as they are now."""
        return self.without(rows.select(*self.keys).distinct()).merged(Index.build(rows, self.keys, *texts))

    def search(self, query: str) -> DataFrame:
        """keys, bm25 of the rows that hold every term."""
        terms = query_terms(query)
        if not terms:
            return self.lengths.where(F.lit(False)).select(*self.keys, F.lit(0.0).alias("bm25"))
        found = self.postings.where(F.col("term").isin(*terms))
        df = found.agg(F.struct(*[F.count_if(F.col("term") == x).alias(f"n{k}") for k, x in enumerate(terms)])).scalar()
        times = found.groupBy(*self.keys, "len").agg(*[F.max(F.when(F.col("term") == x, F.col("tf"))).alias(f"f{k}") for k, x in enumerate(terms)])
        all_ = self.totals.select(F.struct("n_rows", (F.col("sum_len") / F.col("n_rows")).alias("avg_len"))).scalar()
        rows = times.where(" AND ".join(f"f{k} IS NOT NULL" for k in range(len(terms)))).withColumn("df", df).withColumn("all", all_)
        return rows.select(*self.keys, _score(len(terms), lambda k: F.col(f"df.n{k}"), F.col("all.n_rows"), F.col("all.avg_len")).alias("bm25"))


    def _places(self, terms: list[str]) -> DataFrame:
        """keys, p0, p1, ...: positions of each term in the rows that hold all of them; no text is read."""
        found = self.postings.where(F.col("term").isin(*terms)).groupBy(*self.keys).agg(*[F.max(F.when(F.col("term") == x, F.col("positions"))).alias(f"p{k}") for k, x in enumerate(terms)])
        return found.where(" AND ".join(f"p{k} IS NOT NULL" for k in range(len(terms)))).select(*self.keys, *[_rising(F.col(f"p{k}")).alias(f"p{k}") for k in range(len(terms))])

    def phrase(self, query: str) -> DataFrame:
        """keys, times: rows in which the query's tokens stand in order, next to each other, and how often."""
        tokens, terms = query_tokens(query), query_terms(query)
        if not tokens:
            return self.lengths.where(F.lit(False)).select(*self.keys, F.lit(0).alias("times"))
        begun = lambda k: lambda at: at - k
        starts = [F.transform(f"p{terms.index(x)}", begun(k)) for k, x in enumerate(tokens)]
        return self._places(terms).select(*self.keys, F.size(reduce(F.array_intersect, starts)).alias("times")).where("times > 0")

    def windows(self, query: str) -> DataFrame:
        """keys, start, span: the smallest stretch of each row that holds all terms, the first of equal ones.

        The terms' position lists are merged into one; at each place the
        stretch that ends there begins at the least of the terms' last places.
        """
        terms = query_terms(query)
        if not terms:
            return self.lengths.where(F.lit(False)).select(*self.keys, F.lit(0).alias("start"), F.lit(0).alias("span"))
        mark = lambda k: lambda at: F.struct(at.alias("at"), F.lit(k).alias("term"))
        marks = F.flatten(F.array(*[F.transform(f"p{k}", mark(k)) for k in range(len(terms))]))
        best = smallest_window(F.array_sort(marks), len(terms))
        return self._places(terms).select(*self.keys, best["start"].alias("start"), best["span"].alias("span"))

    def near(self, query: str, within: int) -> DataFrame:
        """keys of the rows in which all terms stand within so many tokens."""
        return self.windows(query).where(F.col("span") <= within).select(*self.keys)


def totals_of(lengths: DataFrame) -> DataFrame:
    """n_rows, sum_len: one row."""
    return lengths.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("len"), F.lit(0)).alias("sum_len"))


def smallest_window(marks: Column, n_terms: int, held: Column | None = None) -> Column:
    """start, span of the smallest stretch with every term; ``marks`` (at, term number from 0) in order.

    With ``held``, an array of term numbers, only those terms are asked for.
    Null where there is no such stretch.
    """
    none = F.lit(None).cast("int")
    numbers = F.array(*[F.lit(k) for k in range(n_terms)])
    last_ = F.transform(numbers, lambda k: none if held is None else F.when(F.array_contains(held, k), none).otherwise(F.lit(2**31 - 1)))
    state = F.struct(last_.alias("last"), none.alias("start"), none.alias("span"))

    def step(s: Column, m: Column) -> Column:
        last = F.transform(s["last"], lambda x, k: F.when(k == m["term"], m["at"]).otherwise(x))
        start = F.array_min(last)
        better = ~F.exists(last, lambda x: x.isNull()) & (s["span"].isNull() | (m["at"] - start + 1 < s["span"]))
        return F.struct(last.alias("last"), F.when(better, start).otherwise(s["start"]).alias("start"), F.when(better, m["at"] - start + 1).otherwise(s["span"]).alias("span"))

    return F.aggregate(marks, state, step)


def snippet(text: Column, query: str, width: int = 16) -> Column:
    """``width`` words around the smallest stretch that holds every term of the query found in the text, each match in brackets.

    Words are what white space parts; one matches where a token of it is a
    term. The stretch stands in the middle; one longer than ``width`` is
    shown from its start. A text without a match is shown from its start.
    """
    terms = query_terms(query)
    words = F.split(F.coalesce(text, F.lit("")), "\\s+")
    if not terms:
        return F.concat(F.array_join(F.slice(words, 1, width), " "), F.when(F.size(words) > width, "...").otherwise(""))
    numbers = F.array(*map(F.lit, terms))
    found = F.transform(words, lambda w: F.array_distinct(F.filter(F.transform(X.index_tokens(w), lambda t: F.array_position(numbers, t).cast("int") - 1), lambda k: k >= 0)))
    marks = F.flatten(F.transform(found, lambda ks, at: F.transform(F.array_sort(ks), lambda k: F.struct(at.cast("int").alias("at"), k.alias("term")))))
    best = smallest_window(marks, len(terms), F.array_distinct(F.flatten(found)))
    first = F.coalesce(F.greatest(best["start"] - F.greatest(F.floor((F.lit(width) - best["span"]) / 2), F.lit(0)), F.lit(0)), F.lit(0)).cast("int")
    marked = F.transform(words, lambda w, k: F.when(F.size(F.get(found, k.cast("int"))) > 0, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.when(first > 0, "...").otherwise(""), F.array_join(F.slice(marked, first + 1, F.lit(width)), " "), F.when(first + width < F.size(words), "...").otherwise(""))

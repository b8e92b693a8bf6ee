"""What searches read, kept as tables: postings of three indexes, the embedder's state, vectors.

The state is a row of segments. A change of some conversations adds a small
one: their rows as they are now, their ids as gone (which hides their rows in
earlier segments) and the change of the totals. A search reads all segments,
each in order of term and then key, so it reads the row groups of its own
terms. When there are many segments, or much of them is hidden, all are merged
into one. What must leave the disk is taken out of the segments that hold it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEARCHABLE, in_states
from . import chunking, fts, vectors

KEYS = {"titles": ("conversation_id",), "messages": ("message_id", "conversation_id"), "chunks": ("chunk_id", "conversation_id")}
#: Segments that are read at most, and the share of hidden rows from which they are merged.
MOST_SEGMENTS = 8
MOST_HIDDEN = 0.2
#: Ids that are looked up as values, which prune what is read; more are joined.
FEW = 1000
_MARK = "search_{}@{:06}".format


def _eligible(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(conversations.where(in_states("state", SEARCHABLE)).select("conversation_id"), "conversation_id", "left_semi")


def chunk_texts(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, conversation_id, text, ordinal: a row per message of a chunk, so that no chunk is gathered as a whole."""
    return chunking.in_chunk(messages, chunks).select("chunk_id", "conversation_id", F.col("content_text").alias("text"), "ordinal")


def embeddings(conversations: DataFrame, messages: DataFrame, chunks: DataFrame, vocabulary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The embedder's state (term, df, idf), fit unless given, and vectors (chunk_id, conversation_id, term, w)."""
    searched = _eligible(conversations, messages)
    vocab = vectors.fit_embedder(searched, "conversation_id", "content_text") if vocabulary is None else vocabulary
    return vocab, vectors.embed(chunk_texts(searched, chunks), ("chunk_id", "conversation_id"), "text", vocab)


def _by_term(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange("term", *keys).sortWithinPartitions("term", *keys)


def _by_conversation(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("conversation_id").sortWithinPartitions("conversation_id")


def _among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of some conversations; a few ids are values that prune the read."""
    few = ids.select("conversation_id").distinct().limit(FEW + 1).collect()
    if len(few) <= FEW:
        return df.where(F.col("conversation_id").isin(*[r[0] for r in few]) if few else F.lit(False))
    return df.join(ids.select("conversation_id").distinct(), "conversation_id", "left_semi").select(*df.columns)


def segments(tables: dict[str, DataFrame]) -> list[int]:
    """Numbers of the stored segments, in order."""
    return sorted(int(n.rpartition("@")[2]) for n in tables if n.startswith("search_gone@"))


def segment_tables(tables: dict[str, DataFrame], numbers: list[int] | None = None) -> list[str]:
    """Names of the tables of stored segments."""
    wanted = {f"{n:06}" for n in (segments(tables) if numbers is None else numbers)}
    return [n for n in tables if n.startswith("search_") and n.rpartition("@")[2] in wanted]


@dataclass
class SearchState:
    """Indexes of titles, messages and chunks, the embedder's state and the chunks' vectors."""

    titles: fts.Index
    messages: fts.Index
    chunks: fts.Index
    vocabulary: DataFrame
    vectors: DataFrame

    @classmethod
    def build(cls, conversations: DataFrame, messages: DataFrame, chunks: DataFrame, vocabulary: DataFrame | None = None) -> SearchState:
        """Of all searchable conversations; with a vocabulary, the embedder isn't fit again."""
        searched, parts = _eligible(conversations, messages), _eligible(conversations, chunks)
        titles = fts.Index.build(conversations.where(in_states("state", SEARCHABLE)), KEYS["titles"], "title", "summary_short")
        said = fts.Index.build(searched, KEYS["messages"], "content_text", "role")
        head = parts.select("chunk_id", "conversation_id", F.concat_ws(" ", "chunk_title", "summary_short").alias("text"), F.lit(-1).alias("ordinal"))
        texts = head.unionByName(chunk_texts(searched, parts))
        vocab, embedded = embeddings(conversations, messages, chunks, vocabulary)
        return cls(titles, said, fts.Index.build(texts, KEYS["chunks"], "text", order="ordinal"), vocab, embedded)

    def without(self, ids: DataFrame) -> SearchState:
        """Without some conversations (conversation_id); the vocabulary stays until it is fit again."""
        gone = ids.select("conversation_id").distinct()
        return replace(self, **{n: getattr(self, n).without(gone) for n in KEYS}, vectors=self.vectors.join(gone, "conversation_id", "left_anti").select(*self.vectors.columns))

    def refreshed(self, conversations: DataFrame, messages: DataFrame, chunks: DataFrame, ids: DataFrame) -> SearchState:
        """With some conversations as they are now: those gone or no longer searchable leave, the others come anew."""
        mine = lambda df: _among(df, ids)
        rest, new = self.without(ids), SearchState.build(mine(conversations), mine(messages), mine(chunks), self.vocabulary)
        return replace(rest, **{n: getattr(rest, n).merged(getattr(new, n)) for n in KEYS}, vectors=rest.vectors.unionByName(new.vectors))

    def tables(self, number: int = 1, gone: DataFrame | None = None, totals: DataFrame | None = None) -> dict[str, DataFrame]:
        """Tables of one segment to store, by name, laid out for reading by term; the first one also has the vocabulary."""
        none = self.vectors.sparkSession.createDataFrame([], "conversation_id string")
        out = {"search_vocabulary": self.vocabulary} if number == 1 else {}
        out |= {_MARK("vectors", number): _by_term(self.vectors, "chunk_id"), _MARK("gone", number): none if gone is None else gone.select("conversation_id").distinct()}
        for name, keys in KEYS.items():
            index = getattr(self, name)
            out |= {_MARK(f"{name}_postings", number): _by_term(index.postings, keys[0]), _MARK(f"{name}_lengths", number): _by_conversation(index.lengths)}
        return out | {_MARK("totals", number): self.counted() if totals is None else totals}

    def counted(self) -> DataFrame:
        """name, n_rows, sum_len, hidden of each index."""
        parts = [getattr(self, n).totals.select(F.lit(n).alias("name"), "n_rows", "sum_len", F.lit(0).cast("long").alias("hidden")) for n in KEYS]
        return reduce(DataFrame.unionByName, parts)

    def change(self, conversations: DataFrame, messages: DataFrame, chunks: DataFrame, ids: DataFrame, number: int) -> dict[str, DataFrame]:
        """Tables of the segment that brings some conversations up to date; only their rows are read and written."""
        new = SearchState.build(*(_among(df, ids) for df in (conversations, messages, chunks)), self.vocabulary)
        left = reduce(DataFrame.unionByName, [_among(getattr(self, n).lengths, ids).select(F.lit(n).alias("name"), "len") for n in KEYS])
        left = left.groupBy("name").agg(F.count(F.lit(1)).alias("gone_rows"), F.sum("len").alias("gone_len"))
        both = new.counted().join(left, "name", "left")
        net = lambda c, g: (F.col(c) - F.coalesce(F.col(g), F.lit(0))).alias(c)
        return new.tables(number, ids, both.select("name", net("n_rows", "gone_rows"), net("sum_len", "gone_len"), F.coalesce("gone_rows", F.lit(0)).alias("hidden")))

    @classmethod
    def load(cls, tables: dict[str, DataFrame]) -> SearchState | None:
        """From stored segments; None where there are none."""
        numbers = segments(tables)
        if not numbers:
            return None
        last = None
        if len(numbers) > 1:
            gone = [tables[_MARK("gone", n)].select("conversation_id", F.lit(n).alias("_gone")) for n in numbers[1:]]
            last = reduce(DataFrame.unionByName, gone).groupBy("conversation_id").agg(F.max("_gone").alias("_gone"))

        def shown(part: str) -> DataFrame:
            """A part of all segments without the rows that a later segment hides."""
            found = [tables[_MARK(part, n)] for n in numbers]
            if last is None:
                return found[0]
            rows = reduce(DataFrame.unionByName, [df.withColumn("_segment", F.lit(n)) for df, n in zip(found, numbers, strict=True)])
            return rows.join(last, "conversation_id", "left").where("_gone IS NULL OR _segment >= _gone").select(*found[0].columns)

        totals = reduce(DataFrame.unionByName, [tables[_MARK("totals", n)] for n in numbers])

        def index(name: str) -> fts.Index:
            own = totals.where(F.col("name") == name).agg(F.sum("n_rows").alias("n_rows"), F.sum("sum_len").alias("sum_len"))
            return fts.Index(shown(f"{name}_postings"), shown(f"{name}_lengths"), own, KEYS[name])

        return cls(**{n: index(n) for n in KEYS}, vocabulary=tables["search_vocabulary"], vectors=shown("vectors"))


def due(tables: dict[str, DataFrame]) -> bool:
    """Whether the stored segments should be merged: there are many, or much of them is hidden."""
    numbers = segments(tables)
    if len(numbers) > MOST_SEGMENTS:
        return True
    if len(numbers) < 2:
        return False
    rows = reduce(DataFrame.unionByName, [tables[_MARK("totals", n)] for n in numbers]).where("name = 'messages'")
    shown, hidden = rows.agg(F.sum("n_rows"), F.sum("hidden")).first()
    return hidden > MOST_HIDDEN * (shown + hidden)


def purged(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Stored search tables as they must be once no row of some conversations may stay on disk.

    Only tables that hold such a row are written anew; the totals change by
    what was still shown; the vocabulary loses terms that no other chunk has.
    """
    state = SearchState.load(tables)
    if state is None:
        return {}
    gone = ids.select("conversation_id").distinct()
    out = {}
    for name in segment_tables(tables):
        if "conversation_id" in tables[name].columns and not _among(tables[name], ids).isEmpty():
            rest = tables[name].join(gone, "conversation_id", "left_anti").select(*tables[name].columns)
            key = next((k for k in ("message_id", "chunk_id", "conversation_id") if k in rest.columns))
            out[name] = _by_term(rest, key) if "term" in rest.columns else _by_conversation(rest)
    left = [_among(getattr(state, n).lengths, ids).groupBy().agg(F.lit(n).alias("name"), (-F.count(F.lit(1))).alias("n_rows"), (-F.coalesce(F.sum("len"), F.lit(0))).alias("sum_len"), F.lit(0).cast("long").alias("hidden")) for n in KEYS]
    last = _MARK("totals", segments(tables)[-1])
    parts = reduce(DataFrame.unionByName, [tables[last], *left])
    out[last] = parts.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("n_rows", "sum_len", "hidden")])
    used = state.vectors.join(gone, "conversation_id", "left_anti").select("term").distinct()
    return out | {"search_vocabulary": state.vocabulary.join(used, "term", "left_semi").select(*state.vocabulary.columns)}

"""Thematic groups: TF-IDF, spherical k-means, labels that leak nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import SEARCHABLE, VISIBLE, in_states
from . import scratch, vectors

MOST_TERMS = 4000
BROAD, FINE = 10, 100
LEAST_CORPUS = 4
LEAST_MEMBERS = 3
#: Rounds in which first centroids are drawn.
START_ROUNDS = 5


def group_documents(conversations: DataFrame) -> DataFrame:
    """conversation_id, text: title twice, tags, summaries."""
    return conversations.select("conversation_id", F.concat_ws("\n", "title", "title", F.array_join("manual_tags", " "), F.array_join("auto_tags", " "), "summary_short").alias("text"))


def tfidf(documents: DataFrame, key: str = "conversation_id", text: str = "text", min_df: int = 2, most: int = MOST_TERMS) -> DataFrame:
    """key, term, w: raw tf times idf, normalised."""
    counts = vectors.term_counts(documents, key, X.tfidf_tokens(F.col(text)))
    vocab = vectors.vocabulary(counts, documents.agg(F.count(F.lit(1))).scalar(), most, min_df)
    return vectors.normalised(counts.join(F.broadcast(vocab), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w")), key)


def assign(weights: DataFrame, centroids: DataFrame, key: str = "conversation_id") -> DataFrame:
    """key, cluster: the centroid with the largest dot product, the lowest number on ties.

    Both sides are sparse and joined on terms; keys that share no term with
    any centroid go to cluster 0.
    """
    dots = weights.join(centroids.select("cluster", "term", F.col("w").alias("cw")), "term").groupBy(key, "cluster").agg(F.sum(F.col("w") * F.col("cw")).alias("dot"))
    best = dots.groupBy(key).agg(F.max(F.struct(F.round("dot", 12).alias("dot"), (-F.col("cluster")).alias("low"))).alias("b")).select(key, (-F.col("b.low")).alias("cluster"))
    return weights.select(key).distinct().join(best, key, "left").select(key, F.coalesce("cluster", F.lit(0)).alias("cluster"))


def centroids(weights: DataFrame, labels: DataFrame, key: str = "conversation_id") -> DataFrame:
    """cluster, term, w: normalised mean of the members."""
    sums = weights.join(labels, key).groupBy("cluster", "term").agg(F.sum("w").alias("w"))
    return vectors.normalised(sums, "cluster")


def _uniform(seed: int, salt: int, key: str) -> Column:
    """A number above 0 and up to 1 that only the key, the seed and the salt decide."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key)), F.lit(1 << 52)) + 1) / float(1 << 52)


def candidates(weights: DataFrame, k: int, key: str = "conversation_id", seed: int = 42, rounds: int = START_ROUNDS) -> DataFrame:
    """candidate (number), key: 1 + 2k * ``rounds`` members at most, drawn far from each other (k-means||).

    The first is that of the lowest hash. Each round draws 2k more at once,
    with weight (1 - similarity)^2 to what is nearest among those drawn: every
    key has an exponential variable of that rate, and the smallest are taken,
    of which each task hands on its own only. How many rounds there are
    doesn't depend on k or on the rows; similarities to earlier candidates are
    kept, so a round meets its new ones only.
    """
    spark = weights.sparkSession
    chosen = [r[0] for r in weights.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(1).collect()]
    near = weights.select(key).distinct().withColumn("s", F.lit(0.0))
    fresh, drawn = chosen, list(chosen)
    for turn in range(rounds):
        if not fresh:
            break
        names = spark.createDataFrame([(x,) for x in fresh], "candidate string")
        mine = weights.join(F.broadcast(names), F.col(key) == F.col("candidate"), "left_semi").select(F.col(key).alias("candidate"), "term", F.col("w").alias("cw"))
        sims = weights.join(F.broadcast(mine), "term").groupBy(key, "candidate").agg(F.sum(F.col("w") * F.col("cw")).alias("s")).groupBy(key).agg(F.max("s").alias("new"))
        near = scratch.table(near.join(sims, key, "left").select(key, F.greatest("s", F.coalesce("new", F.lit(0.0))).alias("s")), "near")
        far = F.pow(F.greatest(1 - F.round("s", 12), F.lit(0.0)), 2)
        times = near.where(F.round("s", 12) < 1).select(key, (-F.log(_uniform(seed, turn, key)) / far).alias("time"))
        fresh = sorted(r[0] for r in times.orderBy("time", key).limit(2 * k).collect())
        drawn += fresh
    return spark.createDataFrame(list(enumerate(drawn)), f"candidate int, {key} string")


def first_centroids(weights: DataFrame, k: int, key: str = "conversation_id", seed: int = 42) -> DataFrame:
    """cluster, term, w: ``k`` members as a start.

    Candidates are weighed by how many keys each is nearest to and chosen by
    weighted k-means++ with squared distance (1 - similarity)^2: they are
    bounded by k, so this is done on the driver. Fewer than k come where
    fewer keys differ.
    """
    few = candidates(weights, k, key, seed)
    vectors_ = scratch.table(weights.join(F.broadcast(few), key).select(F.col("candidate").alias("cluster"), "term", "w"), "candidates")
    sizes = {r.cluster: r.n for r in assign(weights, vectors_, key).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = vectors_.toArrow()
    numbers, terms = np.unique(rows["cluster"].to_numpy(), return_inverse=True), np.unique(rows["term"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    x = np.zeros((len(numbers[0]), len(terms[0])))
    x[numbers[1], terms[1]] = rows["w"].to_numpy()
    size = np.array([sizes.get(int(c), 0) for c in numbers[0]], float)
    rng, near, picked = np.random.default_rng(seed), np.zeros(len(x)), []
    for _ in range(min(k, len(x))):
        mass = size * np.maximum(1 - np.round(near, 12), 0) ** 2
        if picked and mass.sum() <= 0:
            break
        mass = np.maximum(mass, 0) if mass.sum() > 0 else np.ones(len(x))
        at = min(int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), "right")), len(x) - 1)
        picked.append(at)
        near = np.maximum(near, x @ x[at])
    chosen = weights.sparkSession.createDataFrame([(k_, int(numbers[0][at])) for k_, at in enumerate(picked)], "number int, old int")
    return vectors_.join(F.broadcast(chosen), F.col("cluster") == F.col("old")).select(F.col("number").alias("cluster"), "term", "w")


def kmeans(weights: DataFrame, k: int, key: str = "conversation_id", rounds: int = 50, checkpoint=None, start: DataFrame | None = None) -> DataFrame:
    """key, cluster by spherical Lloyd steps; an empty cluster keeps its centroid.

    ``start`` has first centroids (cluster, term, w), else they are drawn. One
    driver round trip a step tells whether a label changed. ``checkpoint`` (a
    function of a DataFrame) cuts lineage; by default each step is a table in
    the shared folder.
    """
    ids = weights.select(key).distinct()
    if k <= 1:
        return ids.select(key, F.lit(0).alias("cluster"))
    if start is None and (few := ids.limit(k + 1).count()) <= k:
        return ids.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("cluster")) if few else ids.select(key, F.lit(0).alias("cluster"))
    save = checkpoint or (lambda d: scratch.table(d, "kmeans"))
    weights = save(weights)
    centres = save(first_centroids(weights, k, key) if start is None else start.select("cluster", "term", "w"))
    labels = None
    for _ in range(rounds):
        new = save(assign(weights, centres, key))
        if labels is not None:
            before = labels.select(key, F.col("cluster").alias("was"))
            if new.join(before, key).where("cluster <> was").isEmpty():
                return new
        labels = new
        fresh = centroids(weights, labels, key)
        kept = centres.join(labels.select("cluster").distinct(), "cluster", "left_anti")
        centres = save(fresh.unionByName(kept.select("cluster", "term", "w")))
    return labels


def distinctive_terms(weights: DataFrame, labels: DataFrame, k: int = 5, key: str = "conversation_id") -> DataFrame:
    """cluster, term, margin, rank: weight less its mean over the other clusters, best k."""
    c = centroids(weights, labels, key)
    n = labels.select(F.countDistinct("cluster").alias("n_clusters")).scalar()
    totals = c.groupBy("term").agg(F.sum("w").alias("total"))
    rows = c.join(totals, "term").withColumn("n_clusters", n).withColumn("margin", F.round(F.col("w") - F.when(F.col("n_clusters") > 1, (F.col("total") - F.col("w")) / (F.col("n_clusters") - 1)).otherwise(0.0), 9))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("margin"), "term"))).where(F.col("rank") <= k).select("cluster", "term", "margin", "rank")


def label(terms: DataFrame) -> DataFrame:
    """cluster, keyword_label."""
    joined = terms.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("l"))
    return joined.select("cluster", F.coalesce(F.nullif("l", F.lit("")), F.lit("(unlabeled)")).alias("keyword_label"))


def regroup(conversations: DataFrame, k: int, level: str, checkpoint=None, start: DataFrame | None = None, rounds: int = 50) -> DataFrame:
    """group_id, level, conversation_id, keyword_label; no group under four conversations."""
    eligible = conversations.where(in_states("state", SEARCHABLE))
    documents = group_documents(eligible)
    if documents.limit(LEAST_CORPUS).count() < LEAST_CORPUS:
        return documents.where(F.lit(False)).select(F.lit("").alias("group_id"), F.lit(level).alias("level"), "conversation_id", F.lit("").alias("keyword_label"))
    weights = tfidf(documents)
    weights = checkpoint(weights) if checkpoint else scratch.table(weights, "group-weights")
    labels = kmeans(weights, k, checkpoint=checkpoint, start=start, rounds=rounds)
    named = label(distinctive_terms(weights, labels))
    group = F.concat(F.lit("grp_"), F.left(F.sha2(F.concat_ws("|", F.lit(level), F.col("cluster").cast("string")), 256), F.lit(16)))
    return labels.join(F.broadcast(named), "cluster", "left").select(group.alias("group_id"), F.lit(level).alias("level"), "conversation_id", F.coalesce("keyword_label", F.lit("(unlabeled)")).alias("keyword_label"))


def safe_labels(conversations: DataFrame, memberships: DataFrame, k: int = 5) -> DataFrame:
    """group_id, safe_label from visible members only; null under three of them.

    Terms are weighed over visible conversations alone, each group against all
    visible conversations outside it.
    """
    shown = conversations.where(in_states("state", VISIBLE))
    weights = tfidf(group_documents(shown), min_df=1)
    mine = memberships.join(shown.select("conversation_id"), "conversation_id", "left_semi").select("group_id", "conversation_id")
    sizes = memberships.select("group_id").distinct().join(mine.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "group_id", "left")
    everything = weights.groupBy("term").agg(F.sum("w").alias("all"))
    sums = weights.join(mine, "conversation_id").groupBy("group_id", "term").agg(F.sum("w").alias("w"))
    # raw sums of the rest, over every term of the corpus, give the norm of each other side
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    inside = sums.join(sums.groupBy("group_id").agg(norm.alias("norm")), "group_id").select("group_id", "term", (F.col("w") / F.col("norm")).alias("w"), F.col("w").alias("raw"))
    squares = everything.agg(F.sum(F.col("all") * F.col("all")).alias("sq")).scalar()
    change = inside.join(everything, "term").groupBy("group_id").agg(F.sum((F.col("all") - F.col("raw")) * (F.col("all") - F.col("raw")) - F.col("all") * F.col("all")).alias("d"))
    rest = change.withColumn("sq", squares).select("group_id", F.sqrt(F.greatest(F.col("sq") + F.col("d"), F.lit(0.0))).alias("rest"))
    margin = F.round(F.col("w") - F.when(F.col("rest") > 1e-9, (F.col("all") - F.col("raw")) / F.col("rest")).otherwise(0.0), 9)
    rows = inside.join(everything, "term").join(rest, "group_id").withColumn("margin", margin)
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("margin"), "term"))).where(F.col("rank") <= k)
    text = top.groupBy("group_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("safe_label"))
    return sizes.join(text, "group_id", "left").select("group_id", F.coalesce("n", F.lit(0)).alias("visible_count"), F.when(F.col("n") >= LEAST_MEMBERS, F.col("safe_label")).alias("safe_label"))


def top_members(weights: DataFrame, labels: DataFrame, n: int = 15, key: str = "conversation_id") -> DataFrame:
    """cluster, key, score, rank: members nearest their centroid."""
    mine = weights.join(labels, key)
    scored = mine.join(centroids(weights, labels, key).select("cluster", "term", F.col("w").alias("cw")), ["cluster", "term"]).groupBy("cluster", key).agg(F.round(F.sum(F.col("w") * F.col("cw")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), key))).where(F.col("rank") <= n)


def display_label(llm: Column, keyword: Column) -> Column:
    return F.coalesce(llm, keyword)

"""BM25 and cosine retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import pairwise
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import words

#: Constants of BM25 Okapi; a negative idf becomes EPSILON times the mean idf.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Items that meet all queries in memory, and vectors of queries at once; their results are joined, so they have no effect on them.
BLOCK, TILE = 10_000, 256


def postings(items: DataFrame, store: list[str], id_col: str, text_col: str) -> DataFrame:
    """(store, id, dl, term, tf) of texts, and for each text a row of its own with a null term; a store is one corpus with
    statistics of its own. A text's words are counted where the text is, without a shuffle."""
    tokens = items.select(*store, F.col(id_col).alias("id"), words(text_col).alias("w"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w")
            lengths = pc.list_value_length(w).to_numpy()
            flat = w.flatten().dictionary_encode()
            of, n = np.repeat(np.arange(len(lengths)), lengths), max(len(flat.dictionary), 1)
            key, times = np.unique(of * n + flat.indices.to_numpy(), return_counts=True)
            row = np.concatenate([key // n, np.arange(len(lengths))])
            term = pa.concat_arrays([flat.dictionary.take(pa.array(key % n)), pa.nulls(len(lengths), flat.dictionary.type)])
            kept = [batch.column(c).take(pa.array(row)) for c in (*store, "id")]
            dl, tf = pa.array(lengths[row], pa.int32()), pa.array(np.concatenate([times, np.zeros(len(lengths), "int64")]), pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, dl, term, tf], names=[*store, "id", "dl", "term", "tf"])

    schema = tokens.drop("w").schema.add("dl", T.IntegerType()).add("term", T.StringType()).add("tf", T.LongType())
    return tokens.mapInArrow(count, schema)


def _with_idf(rows: DataFrame, store: list[str]) -> DataFrame:
    """Rows (store, term or null, df, and the sums terms, docs, total) with idf and avgdl, those without a term left out.

    Terms that nobody asks for come in as one row for each df, so that a store's window holds what is asked for and little more."""
    w = Window.partitionBy(*store) if store else Window.partitionBy(F.lit(0))
    rows = rows.withColumn("n", F.sum("docs").over(w)).withColumn("avgdl", F.sum("total").over(w) / F.col("n"))
    rows = rows.withColumn("idf", F.when(F.col("df").isNotNull(), F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    rows = rows.withColumn("mean_idf", F.sum(F.col("terms") * F.col("idf")).over(w) / F.sum("terms").over(w)).filter("term IS NOT NULL")
    return rows.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))).drop("n", "mean_idf", "terms", "docs", "total")


def bm25(items: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_col: str, k: int, store: list[str] | None = None) -> DataFrame:
    """The k best items of each query: (query_id, id, rank, score), scores rounded to six decimals before ranking, ties by id.

    Items that share no term with the query score 0 and are not returned. A store without any token returns nothing.
    """
    asked = queries.select(*(store or []), F.col(query_id).alias("__q"), F.explode(words(query_col)).alias("term")).groupBy(*(store or []), "__q", "term").agg(F.count(F.lit(1)).alias("times"))
    scores = _scores_by_store(items, asked, store, id_col, text_col) if store else _best_of_blocks(items, asked, id_col, text_col, k)
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("__q").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select(F.col("__q").alias(query_id), F.col("id").alias(id_col), "rank", "score")


def _scores_by_store(items: DataFrame, asked: DataFrame, store: list[str], id_col: str, text_col: str) -> DataFrame:
    """(__q, id, score) of all items that share a term with a query of their store. The postings are shuffled once, by (store,
    term); there they are counted and those that are asked for go on, the others as sums."""
    known = [F.col(s).isNotNull() for s in store]
    index = postings(items.filter(reduce(and_, known)), store, id_col, text_col)
    w = Window.partitionBy(*store, "term")
    counted = index.withColumn("df", F.count("term").over(w)).withColumn("__first", F.row_number().over(w.orderBy("term")) == 1)
    wanted = asked.select(*store, "term").distinct().withColumn("__asked", F.lit(True))
    flagged = counted.join(wanted, [*store, "term"], "left")
    own = lambda c: F.when(F.col("__asked"), F.col(c)).alias(c)
    blank = F.col("term").isNull()
    rows = flagged.select(
        *store, F.when(~blank, F.col("df")).alias("df"), *map(own, ("term", "id", "tf")), F.when(F.col("__asked"), F.col("dl")).alias("__dl"),
        (~blank & F.col("__first")).cast("long").alias("terms"), blank.cast("long").alias("docs"), F.when(blank, F.col("dl")).otherwise(0).cast("long").alias("total"),
    ).groupBy(*store, "df", "term", "id", "tf", "__dl").agg(*[F.sum(c).alias(c) for c in ("terms", "docs", "total")])
    met = asked.join(_with_idf(rows, store), [*store, "term"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("__dl") / F.col("avgdl")))
    return met.groupBy("__q", "id").agg(F.round(F.sum(part), 6).alias("score"))


def _best_of_blocks(items: DataFrame, asked: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(__q, id, score) of the k best items of each query in each block of about BLOCK items, exact.

    One pass counts the terms of all items. In a second one every block meets all queries and keeps its best, so that the pairs of
    queries and items, which grow as their product, are summed in memory and never shuffled."""
    w = items.select(words(text_col).alias("w")).select(F.size("w").alias("dl"), F.explode(F.array_append(F.array_distinct("w"), F.lit(None).cast("string"))).alias("term"))
    counted = w.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl")).otherwise(0)).alias("total"))
    flagged = counted.join(asked.select("term").distinct().withColumn("__asked", F.lit(True)), "term", "left")
    blank = F.col("term").isNull()
    rows = flagged.select(
        F.when(~blank, F.col("df")).alias("df"), F.when(F.col("__asked"), F.col("term")).alias("term"),
        (~blank).cast("long").alias("terms"), F.when(blank, F.col("df")).otherwise(0).alias("docs"), "total",
    ).groupBy("df", "term").agg(*[F.sum(c).alias(c) for c in ("terms", "docs", "total")])
    weighed = asked.join(_with_idf(rows, []), "term").withColumn("weight", F.col("times") * F.col("idf"))
    sets = weighed.groupBy("__q").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"), F.first("avgdl").alias("avgdl"))
    blocks = _blocks(items)
    sets = sets.withColumn("blocks", blocks).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("__b")).drop("blocks")
    docs = items.withColumn("blocks", blocks).select(F.pmod(F.hash(id_col), F.col("blocks")).alias("__b"), F.col(id_col).alias("id"), words(text_col).alias("w"))
    schema = T.StructType([sets.schema["__q"], docs.schema["id"], T.StructField("score", T.DoubleType())])
    return docs.groupBy("__b").cogroup(sets.groupBy("__b")).applyInArrow(partial(_best, k), schema)


def _blocks(items: DataFrame) -> Column:
    return F.greatest(F.ceil(items.agg((F.count(F.lit(1)) / BLOCK).alias("n")).scalar()).cast("int"), F.lit(1))


def _places(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id among the sorted ones."""
    place = np.empty(len(ids), "int64")
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return place


def _top(score: np.ndarray, at: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of at with the best scores, rounded to six decimals, ties by place; NaN is the best, as in an ORDER BY."""
    order = np.where(np.isnan(score), np.inf, score) if np.isnan(score).any() else score
    if len(order) > k:
        kept = np.flatnonzero(order >= np.partition(order, len(order) - k)[len(order) - k] - 2e-6)
        score, order, at = score[kept], order[kept], at[kept]
    score, order = (np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0 for x in (score, order))
    top = np.lexsort((place[at], -order))[:k]
    return at[top], score[top]


def _best(k: int, docs: pa.Table, sets: pa.Table) -> pa.Table:
    """The k best of docs for each query of sets; what ties with the last to six decimals is ranked by id, as in the whole."""
    n, asked = len(docs), sets.column("terms").combine_chunks()
    vocabulary = asked.flatten().unique()
    if not n or not len(vocabulary):
        return pa.table({"__q": sets.column("__q").slice(0, 0), "id": docs.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
    w = docs.column("w").combine_chunks()
    lengths = pc.list_value_length(w).to_numpy()
    code = pc.fill_null(pc.index_in(w.flatten(), vocabulary), -1).to_numpy()
    key, tf = np.unique(code[code >= 0].astype("int64") * n + np.repeat(np.arange(n), lengths)[code >= 0], return_counts=True)
    row = key % n
    value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / sets.column("avgdl")[0].as_py()))
    bounds = np.searchsorted(key // n, np.arange(len(vocabulary) + 1))
    # a term of many docs is one vector over all of them
    lists = [(row[a:z], value[a:z]) for a, z in pairwise(bounds.tolist())]
    whole = {t: np.bincount(r, v, n) for t, (r, v) in enumerate(lists) if 5 * len(r) > n}
    place = _places(docs.column("id"))
    terms, weights, ends = pc.index_in(asked.flatten(), vocabulary).to_numpy(), sets.column("weights").combine_chunks().flatten().to_numpy(), np.cumsum(pc.list_value_length(asked).to_numpy())
    of, found, scores = [], [], []
    for q, (a, z) in enumerate(pairwise([0, *ends.tolist()])):
        score = np.zeros(n)
        for t, x in zip(terms[a:z].tolist(), weights[a:z].tolist()):
            if t in whole:
                score += x * whole[t]
            else:
                r, v = lists[t]
                score[r] += x * v
        # where all weights are positive, so is the score of an item that has a term
        at = np.flatnonzero(score) if (weights[a:z] > 0).all() else np.unique(np.concatenate([lists[t][0] for t in terms[a:z].tolist()]))
        top, got = _top(score[at], at, place, k)
        of.append(np.full(len(top), q))
        found.append(top)
        scores.append(got)
    return pa.table({"__q": sets.column("__q").take(pa.array(np.concatenate(of))), "id": docs.column("id").take(pa.array(np.concatenate(found))), "score": pa.array(np.concatenate(scores))})


def unit(vector: str) -> Column:
    """A vector scaled to length 1; null for the zero vector."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, query_id: str, k: int) -> DataFrame:
    """The k nearest vectors of each query by cosine: (query_id, id, rank, score), exact.

    Vectors fall into blocks of about BLOCK by a hash of their id, each query goes to each block once, where products of matrices
    give the scores, each block keeps its k best, and the best of these remain. Zero vectors match nothing.
    """
    blocks = _blocks(vectors)
    placed = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("blocks", blocks).select(F.pmod(F.hash("id"), F.col("blocks")).alias("__b"), "id", "v")
    sent = queries.select(F.col(query_id).alias("__q"), F.col(vector_col).alias("qv")).withColumn("blocks", blocks).select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("__b"), "__q", "qv")
    schema = T.StructType([sent.schema["__q"], placed.schema["id"], T.StructField("score", T.DoubleType())])
    best = placed.groupBy("__b").cogroup(sent.groupBy("__b")).applyInArrow(partial(_nearest, k), schema)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("__q").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("__q").alias(query_id), F.col("id").alias(id_col), "rank", "score")


def _units(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (rows, their vectors scaled to length 1)}, without null and zero vectors and those with a null in them."""
    a, found = pa.concat_arrays([*vectors.chunks, pa.array([], vectors.type)]), {}
    lengths = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        flat = a.take(pa.array(rows)).flatten()
        v = flat.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, size)
        norm = np.sqrt((v * v).sum(axis=1))
        kept = (norm != 0) & ~pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1)
        found[size] = rows[kept], v[kept] / norm[kept, None]
    return found


def _nearest(k: int, vectors: pa.Table, sent: pa.Table) -> pa.Table:
    """The k best of vectors for each of the queries sent. Vectors of another length than a query's match it in no way."""
    of, found, scores = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0)]
    place, left, right = _places(vectors.column("id")), _units(vectors.column("v")), _units(sent.column("qv"))
    for size in left.keys() & right.keys():
        (at, v), (asked, q) = left[size], right[size]
        for start in range(0, len(asked), TILE):
            for i, score in zip(asked[start : start + TILE].tolist(), q[start : start + TILE] @ v.T):
                top, got = _top(score, at, place, k)
                of.append(np.full(len(top), i))
                found.append(top)
                scores.append(got)
    return pa.table({"__q": sent.column("__q").take(pa.array(np.concatenate(of))), "id": vectors.column("id").take(pa.array(np.concatenate(found))), "score": pa.array(np.concatenate(scores))})


def within_budget(ranked: DataFrame, query_id: str, tokens: str, budget: int) -> DataFrame:
    """Hits of each query up to the last rank at which the running sum of tokens stays within the budget; the first always stays."""
    w = Window.partitionBy(query_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("upto", F.sum(tokens).over(w)).filter((F.col("upto") <= budget) | (F.col("rank") == 1))

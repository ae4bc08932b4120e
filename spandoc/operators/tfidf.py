"""TF-IDF over one- and two-word terms: smoothed idf, L2-normed rows, bounded vocabulary."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from spandoc.functions.text import bigrams, terms
from spandoc.plans.storage import cut_lineage

# Vocabulary bound and smallest document frequency.
MAX_FEATURES = 30000
MIN_DF = 3
# A vocabulary up to this size (two short columns) is sent to every task.
BROADCAST_TERMS = 200000
# Words of a task whose terms are counted together.
WORDS_AT_ONCE = 1 << 20


def arrays_pairs(arr: Column) -> Column:
    """Adjacent elements of an array as structs (a, b)."""
    n = F.greatest(F.size(arr) - 1, F.lit(0))
    return F.zip_with(F.slice(arr, F.lit(1), n), F.slice(arr, F.lit(2), n),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _counted(words: DataFrame) -> DataFrame:
    """(entity_id, term, tf) of every row's words ``w``, counted inside the row."""
    def counted(lists: pa.Array) -> pa.Array:
        lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), lengths)
        pair = np.flatnonzero(row[1:] == row[:-1])
        pairs = pc.binary_join_element_wise(flat.take(pa.array(pair)), flat.take(pa.array(pair + 1)), " ")
        found = pa.concat_arrays([flat, pairs.cast(flat.type)]).dictionary_encode()
        size = max(len(found.dictionary), 1)
        keys, tf = np.unique(np.concatenate([row, row[pair]]) * size + np.asarray(found.indices, np.int64), return_counts=True)
        runs = pa.StructArray.from_arrays([found.dictionary.take(pa.array(keys % size)), pa.array(tf.astype(np.int64))], ["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(keys // size, np.arange(len(lists) + 1)), pa.int32()), runs)

    @F.arrow_udf("array<struct<term:string,tf:bigint>>")
    def runs(w: pa.Array) -> pa.Array:
        sizes, parts, lo = np.cumsum(np.asarray(w.value_lengths().fill_null(0), np.int64)), [], 0
        while lo < len(w):
            hi = max(int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + WORDS_AT_ONCE, "right")), lo + 1)
            parts.append(counted(w.slice(lo, hi - lo)))
            lo = hi
        return pa.concat_arrays(parts) if parts else counted(w)

    return words.select("entity_id", F.inline(runs("w")))


def term_counts(entities: DataFrame, text: str = "text") -> DataFrame:
    """(entity_id, term, tf).

    The words of a text are dealt by entity once; its terms are counted inside its row, so no table of single
    terms is grouped, and norming the weights later needs no further exchange.  Only ids that come on several rows
    have the counts of their rows added up.
    """
    counts = _counted(entities.select("entity_id", terms(F.col(text)).alias("w")).repartition("entity_id"))
    repeated = entities.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("entity_id").alias("again"))
    if repeated.isEmpty():
        return counts
    same = F.col("entity_id").eqNullSafe(F.col("again"))
    added = counts.join(repeated, same, "left_semi").groupBy("entity_id", "term").agg(F.sum("tf").alias("tf"))
    return counts.join(repeated, same, "left_anti").unionByName(added)


def fit_vocabulary(counts: DataFrame, max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> DataFrame:
    """(term, term_id, df, total_tf): frequent terms, ties by term, ids in term order."""
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
    kept = stats.filter(F.col("df") >= min_df).orderBy(F.desc("total_tf"), "term").limit(max_features)
    # At most max_features rows reach this window.
    return kept.withColumn("term_id", F.row_number().over(Window.orderBy("term")).cast("bigint") - 1)


@dataclass(frozen=True)
class TfidfModel:
    """Fitted vocabulary with idf; ``n_docs`` is the number of training entities."""

    vocabulary: DataFrame
    n_docs: int
    max_features: int

    def transform(self, counts: DataFrame) -> DataFrame:
        """(entity_id, term_id, term, weight), each entity normed to length 1."""
        idf = F.log((F.lit(1.0) + F.lit(float(self.n_docs))) / (F.lit(1.0) + F.col("df"))) + 1.0
        vocab = self.vocabulary.select("term", "term_id", idf.alias("idf"))
        if self.max_features <= BROADCAST_TERMS:
            vocab = F.broadcast(vocab)
        raw = counts.join(vocab, "term").select(
            "entity_id", "term_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
        # One number per entity meets its terms; a window would sort them all.
        square = F.sum(F.col("w") * F.col("w"))
        norms = raw.groupBy("entity_id").agg(F.sqrt(square).alias("norm")).hint("shuffle_hash")
        normed = raw.join(norms, "entity_id")
        nameless = raw.filter(F.col("entity_id").isNull())
        normed = normed.unionByName(nameless.crossJoin(F.broadcast(nameless.agg(F.sqrt(square).alias("norm")))))
        return normed.select("entity_id", "term_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def fit_tfidf(train_counts: DataFrame, n_docs: int, max_features: int = MAX_FEATURES,
              min_df: int = MIN_DF) -> TfidfModel:
    """The vocabulary is stored: norms and weights read it, and its terms are counted once."""
    return TfidfModel(cut_lineage(fit_vocabulary(train_counts, max_features, min_df)), n_docs, max_features)

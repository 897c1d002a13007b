"""Ranked lexical search by a threshold-seeded join, in integer arithmetic.

A posting's ratio is ``(1000000000*tf) div (1000*tf + 20*m)``, its impact the term's weight times the ratio. Stored per
term: in how many documents it stands, its largest ratio and its k largest ones. Then, for each item:

1. The k-th impact of each of its terms bounds its k-th score from below, as k documents have at least that; the largest
   such bound seeds the item's threshold. The documents of the stored postings that pass it are scored exactly, and
   their k-th score raises the threshold. Both are scores that k documents reach, so neither can lose a result.
2. Terms are put in falling order of their largest impact. A document whose first term in that order is the i-th scores at
   most that posting's impact and the sum of the largest impacts after i (the suffix bound). Postings whose impact and
   suffix bound stay below the threshold name no candidate; whole terms at the end drop out that way.
3. Candidates are scored exactly over all terms of the item, and the first k are ranked.

Documents are read once, into a table of what they hold of the items' terms; a bitmap of fixed size, filled from the
items, tells most other terms apart before anything is written. Terms are told apart by 64-bit hashes.

Defined results: a null or empty text has no term and never scores; an item without terms, or whose terms stand in no
document, has no row. Each row of the documents is a document and each row of the items an item, repeated ids and texts
included; rows of equal score and doc_id are equal in all that is returned. Null ids are returned as they are, a null
doc_id last among equal scores. Other columns are not used. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epsforest.llm.textscan import ALNUM, LOWER, U64, pieces, rows_of, span_hashes, spans
from epsforest.operators.skew import split_join
from epsforest.runtime import cut

#: Bits of the bitmap of the items' terms, as a power of two: 2 MB whatever the items.
BITS = 24
#: Rows of the items' terms that are broadcast at most; more of them are joined by a shuffle that splits hot terms.
SMALL_TERMS = 200_000


def _terms(bitmap: np.ndarray | None):
    """(row, id, n, terms, tf) of (row, id, text): how many terms a text has, and the distinct ones that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offs in pieces(batch.column(2)):
                low = LOWER[buf]
                starts, ends = spans(low, offs, ALNUM)
                terms, at = span_hashes(low, starts, ends), rows_of(starts, offs)
                n = np.bincount(at, minlength=end - row)
                if bitmap is not None:
                    slot = (terms >> U64(64 - BITS)).astype(np.int64)
                    known = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    terms, at = terms[known], at[known]
                order = np.lexsort((terms, at))
                terms, at = terms[order], at[order]
                first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (at[1:] != at[:-1])]) if len(terms) else np.zeros(0, np.int64)
                tf = np.diff(np.r_[first, len(terms)]).astype(np.int64)
                offsets = pa.array(np.searchsorted(at[first], np.arange(end - row + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (terms[first].view(np.int64), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(n.astype(np.int64)), *lists], ["row", "id", "n", "terms", "tf"])

    return run


def _read(df: DataFrame, key: str, bitmap: np.ndarray | None = None) -> DataFrame:
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), "text")
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_terms(bitmap), f"row long, id {kind}, n long, terms array<long>, tf array<long>").where("n > 0")


def _bitmap(terms: DataFrame) -> np.ndarray:
    """The items' terms as bits: at most 2**BITS / 64 rows come to the driver, whatever the items."""
    slot = F.shiftrightunsigned("term", 64 - BITS)
    words = terms.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - BITS}) & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out.view(np.uint8)


def _postings(docs: DataFrame, ratio: Column, *also: str) -> DataFrame:
    """(row, id, .., term, ratio): a row for each document and term."""
    each = docs.select("row", "id", *also, "n", "tf", F.posexplode("terms").alias("_k", "term"))
    return each.select("row", "id", *also, "term", "n", F.get("tf", F.col("_k")).alias("tf")).select("row", "id", *also, "term", ratio.alias("ratio"))


def _first(df: DataFrame, by: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each ``by``; Spark cuts to k rows in every map task before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def _exact(candidates: DataFrame, docs: DataFrame, weights: DataFrame, ratio: Column) -> DataFrame:
    """(item, row, id, score) of candidates (item, row) over all terms of their items."""
    held = _postings(docs.join(candidates, "row"), ratio, "item")
    met = held.join(weights.select("item", "term", "w"), ["item", "term"])
    return met.groupBy("item", "row").agg(F.first("id").alias("id"), F.sum(F.col("w") * F.col("ratio")).alias("score"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, small_terms: int = SMALL_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    asked = cut(_read(items, "item_id"), "items")
    names = asked.select(F.col("row").alias("item"), F.col("id").alias("item_id"))
    wanted = asked.select(F.col("row").alias("item"), F.explode("terms").alias("term"))
    held = cut(_read(docs, "doc_id", _bitmap(wanted)), "held")
    facts = held.agg(F.count("*").alias("n"), F.sum("n").alias("all")).first()
    if not facts["n"]:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    ratio = F.expr(f"(1000000000L * tf) div (1000 * tf + 20 * (50 + (50 * n * {facts['n']}L) div {facts['all']}L))")
    postings = _postings(held, ratio)

    known = wanted.select("term").distinct()
    stored = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("ratio").alias("top")).join(known, "term")
    stored = cut(stored.withColumn("w", F.floor(1000 * F.log(F.lit(2.0 * facts["n"] + 2) / (2.0 * F.col("df") + 1))).cast("long")), "terms")
    best = cut(_first(postings.select("term", "row", "ratio"), "term", [F.desc("ratio"), F.asc("row")], k), "best")  # the k largest of each term
    kth = best.where(F.col("rank") == k).select("term", F.col("ratio").alias("kth"))

    # the sum over all terms that come later in falling order, seen from the other end
    after = Window.partitionBy("item").orderBy(F.asc("most"), F.desc("term")).rowsBetween(Window.unboundedPreceding, -1)
    weights = wanted.join(stored.where("w > 0").join(kth, "term", "left"), "term").withColumn("most", F.col("w") * F.col("top"))
    weights = weights.withColumns({"suffix": F.coalesce(F.sum("most").over(after), F.lit(0)), "seed": F.max(F.col("w") * F.coalesce("kth", F.lit(0))).over(Window.partitionBy("item"))})
    weights = cut(weights.select("item", "term", "w", "df", "suffix", F.greatest("seed", F.lit(1)).alias("seed")), "weights")
    small = weights.count() <= small_terms
    side = F.broadcast if small else (lambda x: x)

    def passing(at: DataFrame, bounds: DataFrame, counts: DataFrame | None) -> DataFrame:
        """(item, row) of postings that may begin a document of at least the item's threshold."""
        bounds = bounds.where("least <= w * 1000000")  # ratios stay below 1,000,000: no posting of the others passes
        if small or counts is None:
            met = at.join(side(bounds), "term")
        else:
            met = split_join(at, bounds, ["term"], counts, int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
        return met.where("w * ratio >= least").select("item", "row").distinct()

    least = lambda threshold: (F.col(threshold) - F.col("suffix")).alias("least")
    tried = passing(best.select("term", "row", "ratio"), weights.select("item", "term", "w", least("seed")), None)
    scored = _first(_exact(tried, held, side(weights), ratio), "item", [F.desc("score")], k)
    raised = scored.where(F.col("rank") == k).select("item", F.col("score").alias("raised"))
    bounds = cut(weights.join(raised, "item", "left").withColumn("threshold", F.greatest("seed", F.coalesce("raised", F.lit(1)))).select("item", "term", "w", least("threshold")), "bounds")
    counts = None if small else stored.select("term", F.col("df").alias("n"))
    found = _exact(cut(passing(postings.select("row", "term", "ratio"), bounds, counts), "candidates"), held, side(weights), ratio)
    ranked = _first(found, "item", [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")], k)
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")

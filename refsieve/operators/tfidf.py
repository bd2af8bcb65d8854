"""TF-IDF weights and cosine pairs of titles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from refsieve.functions import text
from refsieve.operators import prefix_join
from refsieve.operators.copies import collapse, copy_pairs, counted_pairs, titled_pairs
from refsieve.session import stored

# Slack on squared norms, so that rounding never shortens a prefix.
SLACK = 1e-9
# Terms of vectors that a bucket of terms is made for, on average.
TERMS_PER_BUCKET = 50_000


def _numbered_terms(groups: DataFrame) -> DataFrame:
    """``term, number, freq, idf`` of all terms; store it before reading ``number`` twice.

    Document frequency counts every copy of a text; ``freq`` counts distinct texts. The idf is
    smoothed: ``ln((1 + n) / (1 + df)) + 1``.
    """
    terms = (
        groups
        .select("copies", F.explode(F.array_distinct(text.terms(F.col("value")))).alias("term"))
        .groupBy("term")
        .agg(F.sum("copies").alias("df"), F.count("*").alias("freq"))
    )
    total = groups.agg(F.sum("copies")).scalar()
    idf = F.log((total + 1) / (F.col("df") + 1)) + 1
    return terms.select("term", F.monotonically_increasing_id().alias("number"), "freq", idf.alias("idf"))


def _weighted_terms(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """``id, copies, term, number, freq, weight`` with unnormalised weights.

    Titles are dealt out by id before they are split, so that counting a title's terms shuffles
    no terms.
    """
    bag = (
        groups.repartition("id")
        .select("id", "copies", F.explode(text.terms(F.col("value"))).alias("term"))
        .groupBy("id", "copies", "term")
        .agg(F.count("*").alias("tf"))
    )
    return bag.join(terms, "term").select(
        "id", "copies", "term", "number", "freq", (F.col("tf") * F.col("idf")).alias("weight")
    )


def _vectors(weighted: DataFrame) -> DataFrame:
    """Unit vectors as ``array<struct<freq, term, weight>>``, rarest term first."""
    entry = F.struct("freq", "term", "weight")
    vectors = weighted.groupBy("id", "copies").agg(F.sort_array(F.collect_list(entry)).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
    vectors = vectors.withColumn("length", length)
    return vectors.select(
        "id",
        "copies",
        F.transform(
            "v",
            lambda x: F.struct(
                x["freq"].alias("freq"),
                x["term"].alias("term"),
                (x["weight"] / F.col("length")).alias("weight"),
            ),
        ).alias("vector"),
    )


def tfidf(df: DataFrame, id_column: str = "DOI", column: str = "title") -> DataFrame:
    """Unit-length TF-IDF weights as rows ``id, term, weight``; one set per distinct text."""
    groups = collapse(df, column, id_column)
    vectors = _vectors(_weighted_terms(groups, _numbered_terms(groups)))
    return vectors.select("id", F.inline("vector")).select("id", "term", "weight")


def _placed(
    threshold: float, rows_per_block: int, id_type: pa.DataType
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function from weighted terms, sorted by title and rarest first, to vectors and their cells."""
    squared = threshold * threshold - SLACK
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    schema = pa.schema({
        "bucket": pa.int32(), "low": pa.int32(), "high": pa.int32(), "id": id_type, "copies": pa.int64(),
        "dealt": pa.int64(), "buckets": pa.int64(), "blocks": longs, "terms": longs, "weights": doubles,
    })

    def gathered(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.r_[0, np.cumsum(sizes)]
        return offsets, np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], sizes)

    def cells_of(titles: pa.Table) -> pa.RecordBatch:
        titles = titles.combine_chunks()
        id_ = titles.column("id").combine_chunks()
        begins = np.r_[0, np.flatnonzero(pc.not_equal(id_[1:], id_[:-1]).to_numpy(zero_copy_only=False)) + 1]
        term, freq, weight = (titles.column(c).to_numpy() for c in ("number", "freq", "weight"))
        sizes = np.diff(np.r_[begins, len(term)])
        weight = weight / np.repeat(np.sqrt(np.add.reduceat(weight * weight, begins)), sizes)
        # A term of one title adds to no product; such terms come first.
        alone = np.add.reduceat((freq == 1).astype(np.int64), begins)
        ends, begins, sizes = begins + sizes, begins + alone, sizes - alone
        # Leading terms up to the point where the rest of the vector is shorter than the threshold.
        sums = np.r_[0.0, np.cumsum(weight * weight)]
        lead = np.repeat(sums[ends], sizes + alone) - sums[:-1] >= squared
        prefix = np.r_[0, np.cumsum(lead)]
        prefix = prefix[ends] - prefix[begins]
        # Where the others are too short, no product is enough.
        kept = prefix > 0
        begins, sizes, prefix, first = begins[kept], sizes[kept], prefix[kept], (ends - 1)[kept]
        copies, dealt = titles.column("copies").to_numpy()[first], titles.column("dealt").to_numpy()[first]
        buckets = int(titles.column("buckets")[0].as_py())
        heads, at = gathered(begins, prefix)
        title, blocks = np.repeat(np.arange(len(begins)), prefix), freq[at] // rows_per_block + 1
        block, bucket = dealt[title] % blocks, term[at] % buckets
        met = np.repeat(np.arange(len(at)), blocks)
        other = np.arange(len(met)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        cells = np.stack([title[met], bucket[met], np.minimum(block[met], other), np.maximum(block[met], other)])
        cells = cells[:, np.lexsort(cells[::-1])]
        cells = cells[:, np.r_[True, (np.diff(cells) != 0).any(axis=0)][: cells.shape[1]]]
        title = cells[0]
        offsets, listed = gathered(begins[title], sizes[title])
        head_offsets, head = gathered(heads[:-1][title], prefix[title])
        return pa.record_batch([
            *(pa.array(c, pa.int32()) for c in cells[1:]), id_.take(pa.array(first[title])),
            pa.array(copies[title]), pa.array(dealt[title]), pa.array(np.full(len(title), buckets)),
            pa.ListArray.from_arrays(pa.array(head_offsets, pa.int32()), pa.array(blocks[head])),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(term[listed])),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(weight[listed])),
        ], schema=schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The terms of the last title of a batch may go on in the next.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            id_ = batch.column("id")
            same = pc.equal(id_, id_[-1]).to_numpy(zero_copy_only=False)
            begin = int(np.argmax(same))
            if begin or (held and held[-1].column("id")[0] != id_[0]):
                yield cells_of(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield cells_of(pa.Table.from_batches(held))

    return place


def _in_cells(weighted: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """A row per vector and cell ``bucket, low, high`` in which a term of its prefix is compared.

    Terms are dealt to buckets, the titles of a term to blocks; every two blocks of a term meet. A
    vector goes once to a cell, however many of its terms lie there. It is shuffled as numbers;
    ``blocks`` has an entry for each term of the prefix.
    """
    id_field = weighted.schema["id"].dataType
    buckets = F.greatest(F.ceil(terms.agg(F.sum("freq")).scalar() / TERMS_PER_BUCKET), F.lit(1))
    together = (
        weighted.filter("id IS NOT NULL").select("id", "copies", "number", "freq", "weight")
        .repartition("id").sortWithinPartitions("id", "freq", "number")
    )
    return together.select(
        "*", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("dealt"), buckets.alias("buckets")
    ).mapInArrow(
        _placed(threshold, prefix_join.ROWS_PER_BLOCK, to_arrow_type(id_field)),
        f"bucket int, low int, high int, id {id_field.simpleString()}, copies long, dealt long, buckets long, "
        "blocks array<long>, terms array<long>, weights array<double>",
    )


def _compared(threshold: float, id_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """Function for a cell: the pairs that reach ``threshold``, each in the cell of its first shared term."""
    squared = threshold * threshold - SLACK
    schema = pa.schema({
        "id1": id_type, "id2": id_type, "copies1": pa.int64(), "copies2": pa.int64(), "score": pa.float64()
    })

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        bucket, low, high = (cell.column(c)[0].as_py() for c in ("bucket", "low", "high"))

        def flat(name: str) -> pa.Array:
            return cell.column(name).combine_chunks().flatten()

        terms = flat("terms").dictionary_encode()
        vocabulary, term = len(terms.dictionary), terms.indices.to_numpy().astype(np.int64)
        number = terms.dictionary.to_numpy()
        weight, blocks = flat("weights").to_numpy(), flat("blocks").to_numpy()
        sizes = pc.list_value_length(cell.column("terms")).to_numpy().astype(np.int64)
        begins = np.r_[0, np.cumsum(sizes)]
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - begins[row]
        # Squared length of what is left of a vector from each place on.
        sums = np.r_[0.0, np.cumsum(weight * weight)]
        rest = sums[begins[row + 1]] - sums[:-1] + SLACK
        prefix = pc.list_value_length(cell.column("blocks")).to_numpy().astype(np.int64)
        lead = np.flatnonzero(place < prefix[row])
        block = cell.column("dealt").to_numpy()[row[lead]] % blocks
        here = (
            (number[term[lead]] % cell.column("buckets")[0].as_py() == bucket)
            & (blocks > high) & ((block == low) | (block == high))
        )
        # Titles of a term, the longest rests first: those that a title may reach follow it at once.
        at, block = lead[here], block[here]
        order = np.lexsort((-rest[at], term[at]))
        at, block = at[order], block[order]
        ends = np.r_[np.flatnonzero(np.diff(term[at])) + 1, len(at)]
        ids, copies = cell.column("id").to_pylist(), cell.column("copies").to_numpy()
        found: list[tuple[int, int, float]] = []
        dense = np.zeros(vocabulary)
        start = 0
        for end in ends.tolist():
            titles, own = at[start:end], block[start:end]
            start = end
            if len(titles) < 2:
                continue
            rows, rests = row[titles], rest[titles]
            n = sizes[rows]
            offsets = np.r_[0, np.cumsum(n)]
            listed = np.arange(offsets[-1]) + np.repeat(begins[rows] - offsets[:-1], n)
            their_term, their_weight = term[listed], weight[listed]
            reach = np.searchsorted(-rests, -squared / rests, side="right").tolist()
            for i, stop in enumerate(reach):
                if stop <= i + 1:
                    break
                mine = slice(offsets[i], offsets[i + 1])
                dense[their_term[mine]] = their_weight[mine]
                first, last = offsets[i + 1], offsets[stop]
                products = dense[their_term[first:last]] * their_weight[first:last]
                scores = np.add.reduceat(products, offsets[i + 1: stop] - first)
                for k in np.flatnonzero(scores >= threshold).tolist():
                    j = i + 1 + k
                    # Pairs within one block belong to the cell of that block with itself.
                    if low != high and own[i] == own[j]:
                        continue
                    begin = offsets[j] - first
                    if not products[begin: begin + place[titles[j]]].any():
                        found.append((rows[i], rows[j], scores[k]))
                dense[their_term[mine]] = 0.0
        pairs = [(a, b, s) if ids[a] < ids[b] else (b, a, s) for a, b, s in found]
        one, two = [a for a, _, _ in pairs], [b for _, b, _ in pairs]
        return pa.table([
            pa.array([ids[a] for a in one], id_type), pa.array([ids[b] for b in two], id_type),
            pa.array(copies[one] if one else [], pa.int64()), pa.array(copies[two] if two else [], pa.int64()),
            pa.array([s for _, _, s in pairs], pa.float64()),
        ], schema=schema)

    return compare


def _near_pairs(groups: DataFrame, threshold: float) -> DataFrame:
    """Pairs of stored ``groups`` as ``id1, id2, copies1, copies2, score, n_pairs``, and copies."""
    terms = stored(_numbered_terms(groups), "terms")
    id_field = groups.schema["id"].dataType
    cells = _in_cells(_weighted_terms(groups, terms), terms, threshold)
    scored = cells.groupBy("bucket", "low", "high").applyInArrow(
        _compared(threshold, to_arrow_type(id_field)),
        f"id1 {id_field.simpleString()}, id2 {id_field.simpleString()}, copies1 long, copies2 long, score double",
    )
    worded = groups.filter(F.col("value").rlike(text.TERM))
    return counted_pairs(scored).unionByName(copy_pairs(worded))


def tfidf_scores(
    df: DataFrame, threshold: float = 0.8, id_column: str = "DOI", column: str = "title"
) -> DataFrame:
    """``tfidf_pairs`` without the titles, for callers that have them."""
    return _near_pairs(stored(collapse(df, column, id_column), "titles"), threshold)


def tfidf_pairs(
    df: DataFrame, threshold: float = 0.8, id_column: str = "DOI", column: str = "title"
) -> DataFrame:
    """Pairs of distinct titles whose TF-IDF cosine reaches ``threshold``, and copies of a title.

    Columns ``id1, id2, copies1, copies2, score, n_pairs, title1, title2``. Vectors go to the cells
    of their leading terms and are compared there, so only pairs that reach the threshold are ever
    shuffled.
    """
    groups = stored(collapse(df, column, id_column), "titles")
    return titled_pairs(_near_pairs(groups, threshold), groups)


def score_band(pairs: DataFrame, low: float = 0.94, high: float = 1.0) -> DataFrame:
    """Pairs within a band of scores; a score of 1 may come out a rounding error above it."""
    return pairs.filter(F.round("score", 9).between(low, high))


def top_pair(pairs: DataFrame) -> DataFrame:
    """The most similar pair of two works."""
    return pairs.orderBy(F.round("score", 9).desc(), "id1", "id2").limit(1)

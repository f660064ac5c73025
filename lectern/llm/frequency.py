"""Frequency of every distinct term, by a global integer dictionary and count arrays.

Records are taken in blocks. A block's terms are encoded by their numbers in the block,
and its occurrences and the records they stand in are counted in arrays over those
numbers. The global dictionary gives every term an identifier: a range (a hash of the
term) and a slot in it (its rank among the range's terms). A block's arrays are cut by
range, and the arrays of a range are laid on its slots and summed. So nothing but
arrays is shuffled, once, and a term that a third of the records carry is one element
of each block's arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import folded
from lectern.sources.tables import cut_lineage

#: Occurrences of a block.
BLOCK = 2_000_000
#: Occurrences that one range is meant for; a range holds fewer distinct terms than that.
PER_RANGE = 1 << 17

_MEASURES = ("occurrences", "records", "added")
_ARRAYS = "range int, terms array<string>, " + ", ".join(f"{m} array<long>" for m in _MEASURES)


def _by_range(terms: pa.Array, measures: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    """A block's arrays cut by the range of each term: one row a range."""
    range_of = np.fromiter((xxhash.xxh3_64_intdigest(t) % ranges for t in terms.to_pylist()), np.int64, len(terms))
    order = np.argsort(range_of, kind="stable")
    met, begin = np.unique(range_of[order], return_index=True)
    ends = pa.array(np.append(begin, len(order)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, values.take(pa.array(order))) for values in (terms, *(pa.array(m, pa.int64()) for m in measures))]
    return pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), *lists], names=["range", "terms", *_MEASURES])


def record_block(lists: list[pa.Array], ranges: int) -> pa.RecordBatch:
    """Encodes the terms of a block's records and counts them; nulls are no terms."""
    column = pa.chunked_array(lists).combine_chunks()
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    terms = column.flatten()
    there = terms.is_valid()
    encoded = terms.filter(there).dictionary_encode()
    codes, size = encoded.indices.to_numpy().astype(np.int64), max(len(encoded.dictionary), 1)
    record = np.repeat(np.arange(len(lengths)), lengths)[there.to_numpy(zero_copy_only=False)]
    occurrences = np.bincount(codes, minlength=len(encoded.dictionary))
    records = np.bincount(np.unique(record * size + codes) % size, minlength=len(encoded.dictionary))
    return _by_range(encoded.dictionary, [occurrences, records, np.zeros(len(occurrences), np.int64)], ranges)


def counted_block(terms: list[pa.Array], counts: list[pa.Array], ranges: int) -> pa.RecordBatch:
    """The same for terms counted elsewhere."""
    encoded = pa.chunked_array(terms).combine_chunks().dictionary_encode()
    added = np.zeros(len(encoded.dictionary), np.int64)
    np.add.at(added, encoded.indices.to_numpy(), pa.chunked_array(counts).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False))
    return _by_range(encoded.dictionary, [np.zeros(len(added), np.int64), np.zeros(len(added), np.int64), added], ranges)


def _sum_arrays(table: pa.Table) -> pa.Table:
    """The dictionary of one range, its terms in order, and the sums of all blocks' arrays over it."""
    flat = {c: table.column(c).combine_chunks().flatten() for c in ("terms", *_MEASURES)}
    encoded = flat["terms"].dictionary_encode()
    order = np.argsort(np.array(encoded.dictionary.to_pylist(), object), kind="stable")
    slot = np.empty(len(order), np.int64)
    slot[order] = np.arange(len(order))
    at, sums = slot[encoded.indices.to_numpy()], []
    for measure in _MEASURES:
        total = np.zeros(len(order), np.int64)
        np.add.at(total, at, flat[measure].to_numpy(zero_copy_only=False))
        sums.append(total)
    identifier = (int(table.column("range")[0].as_py()) << 32) + np.arange(len(order))
    return pa.table({"id": pa.array(identifier, pa.int64()), "term": encoded.dictionary.take(pa.array(order))} | {m: pa.array(t, pa.int64()) for m, t in zip(_MEASURES, sums)})


def encoded_frequencies(records: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """`id, term, occurrences, records, added`: the dictionary with the counts of its terms. Defined as `term_frequencies`."""
    occurrences = records.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    ranges = 1 + (max(occurrences, 0) + (counted.count() if counted is not None else 0)) // PER_RANGE

    def of_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0))
            size += len(batch.column(0).flatten())
            if size > BLOCK:
                yield record_block(held, ranges)
                held, size = [], 0
        if size:
            yield record_block(held, ranges)

    def of_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, size = [], [], 0
        for batch in batches:
            terms.append(batch.column(0))
            counts.append(batch.column(1))
            size += batch.num_rows
            if size > BLOCK:
                yield counted_block(terms, counts, ranges)
                terms, counts, size = [], [], 0
        if size:
            yield counted_block(terms, counts, ranges)

    blocks = records.select(F.col("terms").cast("array<string>")).filter("size(terms) > 0").mapInArrow(of_records, _ARRAYS)
    if counted is not None:
        blocks = blocks.unionByName(counted.filter("term is not null").select("term", F.col("count").cast("long")).mapInArrow(of_counted, _ARRAYS))
    return blocks.groupBy("range").applyInArrow(_sum_arrays, "id long, term string, occurrences long, records long, added long")


def term_frequencies(records: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """`term, occurrences, records, added` of every distinct term.

    records: `terms` (an array; nulls in it are no terms), a row for each record.
    counted: `term, count` of counts made elsewhere, summed as `added`. Defined
    cases: null and empty arrays and null terms give nothing, a null count counts
    0, a term twice in a record is two occurrences in one record, a record may
    have any number of terms, other columns are ignored, empty inputs give no rows.
    """
    return encoded_frequencies(records, counted).select("term", *_MEASURES)


def current_notes(notes: DataFrame) -> DataFrame:
    """`note_id, tags` of the newest version of each note that isn't deleted.

    A version delivered twice counts once; between different rows of one version
    the later arrival holds. Rows without note_id are no notes; a null version
    is the oldest.
    """
    newest = F.struct(F.coalesce("version", F.lit(-1)), "arrived_at", "deleted_at", "tags")
    return notes.filter("note_id is not null").groupBy("note_id").agg(F.max(newest).alias("newest")).filter("newest.deleted_at is null").select("note_id", "newest.tags")


def archived_counts(counts: DataFrame) -> DataFrame:
    """`term, source_id, count`: the latest count of each batch and tag; null and negative count 0.

    Spellings of a tag are one tag. Of several counts at one moment the largest holds.
    """
    latest = F.max(F.struct("counted_at", F.coalesce("count", F.lit(0)).alias("count")))
    return (
        counts.select(F.col("batch").alias("source_id"), folded(F.col("tag")).alias("term"), "count", "counted_at")
        .filter("term <> ''")
        .groupBy("source_id", "term")
        .agg(F.greatest(latest["count"], F.lit(0)).alias("count"))
    )


def tag_frequencies(notes: DataFrame, counts: DataFrame, rare: int = 3, common_percent: int = 12) -> DataFrame:
    """`tag, occurrences, here, archived, mark` of every tag of current notes and archives.

    mark is `rare` for 1 to `rare` uses here and archived, `common` for a tag in
    more than `common_percent` of the current notes (where both hold, rare),
    else null.
    """
    terms = F.filter(F.transform(F.coalesce("tags", F.array()), folded), lambda t: t != "")
    current = cut_lineage(current_notes(notes).select(terms.alias("terms")))  # read three times
    total = current.count()
    found = term_frequencies(current, cut_lineage(archived_counts(counts)))
    uses = F.col("records") + F.col("added")
    mark = F.when(uses.between(1, rare), "rare").when(F.col("records") * 100 > common_percent * total, "common")
    return found.select(F.col("term").alias("tag"), "occurrences", F.col("records").alias("here"), F.col("added").alias("archived"), mark.alias("mark"))

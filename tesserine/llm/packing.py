"""Best-fit packing of token pieces into sequences, in bulk-synchronous supersteps.

Open sequences are gaps, pieces not yet placed are items. A superstep sorts gaps and items together by size, in ranges
over all tasks, and each task sweeps its range from the largest downwards: a gap goes on a stack, an item takes the gap on
top, which is the smallest that it fits, its successor. Items of a range whose own gaps are used up want gaps of larger
ranges: what each range has left over is told by two numbers, and items and gaps left over are matched by their ranks. Then
gaps shrink by what they took, new sequences are opened for items that no gap can hold, and the next superstep begins.

A gap that would hold several of the largest items left is as many slots, so that it can take several items at once. Pieces
of at most 1 / SMALL of a sequence are bundled where they are made, up to 2 / SMALL, and a bundle is one item.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, cut, pick, release, settle
from .tokens import library

CAPACITY = 2048
SMALL = 64
#: About so many rows are sorted and swept by one task.
RANGE = 1 << 16


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole if it fits, else full pieces after a first one of the rest."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (item, within, doc_id, piece, start, length, ids_crc32): within is where in its item a piece begins."""
    kinds = {"item": pa.int64(), "within": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    schema = pa.schema(list(kinds.items()))
    small, most = capacity // SMALL, 2 * capacity // SMALL

    def run(batches):
        held = library(tokenizer)
        ids_of, item = held.encode, TaskContext.get().partitionId() << 40
        bundle, fill = -1, most
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows: list[tuple] = []
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, ids in zip(part.column(0).to_pylist(), ids_of(texts)):
                    raw = ids + b"\0\0\0\0"
                    for k, (start, n) in enumerate(pieces_of(len(raw) // 4, capacity)):
                        crc = zlib.crc32(raw[4 * start : 4 * (start + n)])
                        if n > small:
                            rows.append((item, 0, key, k, start, n, crc))
                            item += 1
                            continue
                        if fill + n > most:
                            bundle, fill, item = item, 0, item + 1
                        rows.append((bundle, fill, key, k, start, n, crc))
                        fill += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            settle()
        held.forget()
        settle()

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "item long, within long, doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(entries: Iterable[tuple[bool, int, int, int, int]]) -> Iterable[tuple]:
    """One range, sorted from the largest value down, gaps before items: (is an item, key, slot, value, gap of the sequence).

    Gives (item, size, sequence_id, slot, gap, rank): a match has no rank; an item without a gap, and a gap without an item,
    have the rank at which they were left over, the smallest gap first.
    """
    stack: list[tuple[int, int, int]] = []
    rank = 0
    for is_item, key, slot, value, gap in entries:
        if not is_item:
            stack.append((key, slot, gap))
        elif stack:
            yield (key, value, *stack.pop(), None)
        else:
            yield key, value, None, None, None, rank
            rank += 1
    for k, top in enumerate(reversed(stack)):
        yield (None, None, *top, k)


def across(left_over: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Ranges (part, items, gaps left over), the largest sizes first, to runs (items' part, first rank, number, gaps' part, shift).

    Items take the gaps left over last, which are the smallest that are larger. Item rank r of a run goes to gap rank r + shift.
    """
    stack: list[list[int]] = []  # part, gaps taken, gaps
    runs = []
    for part, items, gaps in sorted(left_over):
        first = 0
        while items and stack:
            held = stack[-1]
            n = min(items, held[2] - held[1])
            runs.append((part, first, n, held[0], held[1] - first))
            first, items, held[1] = first + n, items - n, held[1] + n
            if held[1] == held[2]:
                stack.pop()
        if gaps:
            stack.append([part, 0, gaps])
    return runs


def superstep(items: DataFrame, gaps: DataFrame, largest: int, rows: int, range_rows: int = RANGE) -> DataFrame:
    """items (item, size) with sequence_id, slot and gap, null for those that found none of the gaps (sequence_id, gap).

    largest: the size of the largest item; rows: how many items and gaps there are, about.
    """
    slots = F.greatest(F.lit(1), F.floor(F.col("gap") / largest)).cast("int")
    open_slots = gaps.withColumn("slots", slots).select(F.lit(False).alias("is_item"), F.col("sequence_id").alias("key"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.floor(F.col("gap") / F.col("slots")).alias("value"), "gap")
    wanting = items.select(F.lit(True).alias("is_item"), F.col("item").alias("key"), F.lit(0).alias("slot"), F.col("size").alias("value"), F.lit(0).cast("long").alias("gap"))
    # Sorted by all columns, so that equal sizes fill as many ranges as they need.
    order = [F.col("value").desc(), F.col("is_item"), F.col("key"), F.col("slot")]
    ranged = open_slots.union(wanting).repartitionByRange(max(1, -(-rows // range_rows)), *order).sortWithinPartitions(*order)
    schema = pa.schema([("part", pa.int32()), *((n, pa.int64()) for n in ("item", "size", "sequence_id")), ("slot", pa.int32()), ("gap", pa.int64()), ("rank", pa.int64())])

    def run(batches):
        part = TaskContext.get().partitionId()
        entries = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        held: list[tuple] = []
        for row in sweep(entries):
            held.append((part, *row))
            if len(held) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    swept = cut(ranged.mapInArrow(run, "part int, item long, size long, sequence_id long, slot int, gap long, rank long"))
    # Two numbers a range come to the driver, and at most two runs a range go out.
    ends = swept.where("rank is not null").groupBy("part").agg(F.count("item").alias("items"), F.count("sequence_id").alias("gaps")).collect()
    runs = across([tuple(r) for r in ends])
    matched = swept.where("rank is null").select("item", "size", "sequence_id", "slot", "gap")
    left = swept.where("rank is not null and item is not null").select("part", "item", "size", "rank")
    if not runs:
        return matched.union(left.selectExpr("item", "size", "null", "null", "null"))
    by_rank = items.sparkSession.createDataFrame(runs, "run_part int, first long, n long, gap_part int, shift long")
    found = left.join(F.broadcast(by_rank), (F.col("part") == F.col("run_part")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")), "left")
    free = swept.where("rank is not null and item is null").select(F.col("part").alias("of_part"), F.col("rank").alias("of_rank"), "sequence_id", "slot", "gap")
    return matched.union(found.join(free, (F.col("gap_part") == F.col("of_part")) & (F.col("rank") + F.col("shift") == F.col("of_rank")), "left").select("item", "size", "sequence_id", "slot", "gap"))


def best_fit(items: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE) -> DataFrame:
    """(item, sequence_id, offset) for items (item, size), sizes from 1 to capacity, by supersteps until all are placed.

    Every superstep places an item at least; the largest item left fits a gap, or a new sequence is opened. In practice
    there are about as many as items in a sequence.
    """
    spark = items.sparkSession
    steps: list[DataFrame] = []
    size = F.col("size")
    told = items.agg(F.count("*").alias("n"), F.sum(size).alias("sum"), F.max(size).alias("max"), F.count_if(size > capacity // 2).alias("big")).first()
    n, largest = told["n"], told["max"]
    made = n_gaps = max(-(-told["sum"] // capacity), told["big"]) if n else 0
    gaps = spark.range(made).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"))
    while n:
        step = cut(superstep(items, gaps, largest, n + n_gaps, range_rows))
        matched, items = step.where("sequence_id is not null"), step.where("sequence_id is null").select("item", "size")
        steps.append(matched.select("item", "size", "sequence_id", "slot", "gap", F.lit(len(steps)).alias("step")))
        took = matched.select("sequence_id", (-F.col("size")).alias("gap"))
        shrunk = cut(gaps.union(took).groupBy("sequence_id").agg(F.sum("gap").alias("gap")))
        most = F.broadcast(shrunk.agg(F.coalesce(F.max("gap"), F.lit(0)).alias("most"), F.count("*").alias("n_gaps")))  # one row
        told = items.join(most, how="cross").agg(F.count("*").alias("n"), F.max("size").alias("max"), F.min("size").alias("min"), F.sum(F.when(size > F.col("most"), size)).alias("over"), F.max("n_gaps").alias("n_gaps")).first()
        n, largest = told["n"], told["max"]
        if n:
            new = -(-(told["over"] or 0) // capacity)
            gaps = shrunk.where(F.col("gap") >= told["min"])
            if new:
                gaps = gaps.union(spark.range(made, made + new).select("id", F.lit(capacity).cast("long")))
            made, n_gaps = made + new, told["n_gaps"] + new
    if not steps:
        return spark.createDataFrame([], "item long, sequence_id long, offset long")
    # What a sequence took in one step stands in the order of its slots, of which it has at most capacity.
    before = Window.partitionBy("sequence_id", "step").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = capacity - F.col("gap") + F.coalesce(F.sum("size").over(before), F.lit(0))
    return functools.reduce(DataFrame.union, steps).select("item", "sequence_id", offset.alias("offset"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, range_rows: int = RANGE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an id 0, so null or empty text gives one piece of one id. Rows with null or repeated doc_id
    are packed each for itself; an empty table gives an empty result; other columns are left out.
    """
    pieces = cut(tokenised_pieces(docs, tokenizer, id_col, text_col, capacity))
    items = cut(pieces.groupBy("item").agg(F.sum("length").alias("size")))
    placed = best_fit(items, capacity, range_rows).withColumnRenamed("item", "of_item")
    release(items)
    rows = pieces.join(placed, F.col("item") == F.col("of_item"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", (F.col("offset") + F.col("within")).alias("offset"))

"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Tokenising deals the pieces into cells of CELL pieces. Each cell evolves on ISLANDS islands, from best fits of the pieces in
random orders. An individual is a list of sequences (bins). Crossover injects whole well-filled bins of one parent into the
other, drops the bins that hold a piece twice, and puts the displaced pieces in by trades and best fit; mutation opens the
emptiest bins and a few others. After each epoch the elite of an island migrates to the next island of its cell. Fewer bins
count first, then bins as unevenly filled as can be, so that what is free gathers in few of them.
Then the pieces of all sequences that are not well filled are dealt into new cells and packed once more, so that what a
cell could not use meets what others could not.

Between epochs only arrays of piece numbers move, a few kilobytes for an island; nothing is gathered on the driver.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.llm.common import drop_stored, release, stored, whole
from lexloom.llm.encode import encoder, ids_crc32
from lexloom.llm.token_file import text_groups

CAPACITY = 4096
CELL = 4000
ISLANDS = 2
EPOCHS = 2
POPULATION = 3
#: Generations of an epoch at most, and those without a better individual after which it ends.
GENERATIONS, STALE = 60, 6
#: Generations of an epoch that go on after the lower bound is met.
SETTLE = 1
#: Bins of a cell for which one above the lower bound is good enough.
SPARE = 800
#: Displaced pieces that are traded against the pieces of bins at most; more are best-fitted only.
TRADED = 24
#: Pieces of text that a worker's encoder keeps, about 200 bytes each; it may hold twice as many.
KEPT_PIECES = 800_000
#: Part of the capacity from which a bin counts as well filled.
WELL_FILLED = 0.995

Bins = list[list[int]]


def _fill(own: list[int], size: list[int]) -> int:
    return sum(map(size.__getitem__, own))


def best_fit(bins: Bins, items: list[int], size: list[int], capacity: int) -> Bins:
    """Adds items in the given order, each to the fullest bin that can take it, else to a new one. Changes bins."""
    # bins by what is free in them, and a bit for each such size that there is
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for b, own in enumerate(bins):
        left = capacity - _fill(own, size)
        room[left].append(b)
        free |= 1 << left
    for i in items:
        n = size[i]
        fits = free >> n
        if fits:
            at = n + (fits & -fits).bit_length() - 1
            b = room[at].pop()
            if not room[at]:
                free ^= 1 << at
            bins[b].append(i)
            left = at - n
        else:
            bins.append([i])
            left, b = capacity - n, len(bins) - 1
        if not room[left]:
            free |= 1 << left
        room[left].append(b)
    return bins


def lower_bound(size: list[int], capacity: int) -> int:
    """Bins that any packing needs: by the sum, and by pieces that cannot share a bin (Martello and Toth's L2)."""
    x = np.sort(np.array(size, np.int64))
    before = np.concatenate(([0], np.cumsum(x)))
    best, half = -(-int(before[-1]) // capacity), int(np.searchsorted(x, capacity // 2, side="right"))
    for k in np.unique(x[:half:max(1, half // 64)]).tolist() if half else [1]:
        alone, least = int(np.searchsorted(x, capacity - k, side="right")), int(np.searchsorted(x, k, side="left"))
        alone = max(alone, half)
        free = (alone - half) * capacity - int(before[alone] - before[half])
        best = max(best, len(x) - half + max(0, -(-(int(before[half] - before[least]) - free) // capacity)))
    return best


def fitness(bins: Bins, size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then bins as unevenly filled as can be (Falkenauer)."""
    return len(bins), -sum(_fill(own, size) ** 2 for own in bins) / capacity**2


def _down(items: list[int], size: list[int]) -> list[int]:
    return sorted(items, key=lambda i: -size[i])


def replace(bins: Bins, loose: list[int], size: list[int], capacity: int) -> list[int]:
    """Trades up to two pieces of a bin for one or two loose ones that fill it better (after Falkenauer); changes bins, returns what is loose then.

    Few pieces are loose where this is used (at most TRADED), so a bin's trades are looked for one by one.
    """
    loose = sorted(loose, key=size.__getitem__)
    for own in bins:
        gap = capacity - _fill(own, size)
        if not gap or len(own) > 8:
            continue
        sizes = [size[i] for i in loose]
        offers = [(sizes[a], (a,)) for a in range(len(loose))] + [(sizes[a] + sizes[c], (a, c)) for a in range(len(loose)) for c in range(a)]
        offers.sort()
        keys, best = [x[0] for x in offers], (0, (), ())
        for gone in [(i,) for i in own] + [(i, j) for k, i in enumerate(own) for j in own[:k]]:
            held = sum(size[i] for i in gone)
            k = bisect_left(keys, held + gap + 1) - 1
            if k >= 0 and keys[k] - held > best[0]:
                best = (keys[k] - held, gone, offers[k][1])
        if best[0]:
            taken = [loose[a] for a in best[2]]
            own[:] = [i for i in own if i not in best[1]] + taken
            loose = sorted([i for i in loose if i not in taken] + list(best[1]), key=size.__getitem__)
    return loose


def repair(child: Bins, displaced: list[int], size: list[int], capacity: int) -> Bins:
    """Puts displaced pieces into a child: by trades while they are few, the rest best-fitted from the largest down."""
    if len(displaced) <= TRADED:
        displaced = replace(child, displaced, size, capacity)
    return best_fit(child, _down(displaced, size), size, capacity)


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, r: random.Random) -> Bins:
    """b with some well-filled bins of a put in whole; bins of b that hold one of their pieces go, the rest of those is displaced and put in anew."""
    good = [own for own in a if _fill(own, size) >= WELL_FILLED * capacity] or sorted(a, key=lambda own: -_fill(own, size))[: len(a) // 2 + 1]
    put = r.sample(good, max(1, len(good) // 2))
    there = {i for own in put for i in own}
    child, displaced = [list(own) for own in put], []
    for own in b:
        if there.isdisjoint(own):
            child.append(list(own))
        else:
            displaced += [i for i in own if i not in there]
    return repair(child, displaced, size, capacity)


def mutate(bins: Bins, size: list[int], capacity: int, r: random.Random) -> Bins:
    """Opens the emptiest bins and some others, and puts their pieces in anew."""
    order = sorted(range(len(bins)), key=lambda b: _fill(bins[b], size))
    out = {*order[: max(1, len(bins) // 20)], *r.sample(order, min(r.randint(1, 4), len(order)))}
    loose = [i for b in out for i in bins[b]]
    return repair([list(own) for b, own in enumerate(bins) if b not in out], loose, size, capacity)


def evolve(size: list[int], capacity: int, seed: int, immigrants: list[Bins] | None = None) -> tuple[list[Bins], int]:
    """An epoch of an island; its individuals, best first, and the generations it took.

    The first individuals are best fits of pieces in random order; what they become is up to crossover and mutation. An
    island rests after STALE generations without a better individual, or once it needs no more bins than the lower bound
    (and one for SPARE, whose pieces are dealt anew in the second pass) and either has one bin at most that is not well
    filled or has had SETTLE generations to gather what is free.
    """
    r, n, bound = random.Random(seed), len(size), lower_bound(size, capacity)
    is_open = lambda own: _fill(own, size) < WELL_FILLED * capacity
    settled = lambda bins, g: len(bins) <= bound + bound // SPARE and (g >= SETTLE or sum(map(is_open, bins)) <= 1)
    people = list(immigrants or []) or [best_fit([], r.sample(range(n), n), size, capacity) for _ in range(POPULATION)]
    rank = lambda x: fitness(x, size, capacity)
    ranked = sorted(((rank(x), x) for x in people), key=lambda x: x[0])
    if immigrants and ranked[0][0][0] > bound:
        # a newcomer where evolution has not reached the bound: roughly from the largest piece down
        new = best_fit([], sorted(range(n), key=lambda i: -size[i] * r.uniform(0.98, 1.02)), size, capacity)
        ranked = sorted([*ranked, (rank(new), new)], key=lambda x: x[0])
    generations = stale = 0
    while generations < GENERATIONS and stale < STALE and not settled(ranked[0][1], generations):
        pick = lambda: r.sample(ranked, 2) if len(ranked) > 1 else ranked * 2
        children = [crossover(a[1], b[1], size, capacity, r) for a, b in (pick() for _ in range(2))]
        children.append(mutate(ranked[0][1], size, capacity, r))
        new = sorted([*ranked, *((rank(x), x) for x in children)], key=lambda x: x[0])[:POPULATION]
        stale = stale + 1 if new[0][0] >= ranked[0][0] else 0
        ranked, generations = new, generations + 1
    return [x for _, x in ranked], generations


def _flat(bins: Bins, n: int) -> list[int]:
    out = np.zeros(n, np.int32)
    for b, own in enumerate(bins):
        out[own] = b
    return out.tolist()


def _unflat(flat: np.ndarray) -> Bins:
    out: Bins = [[] for _ in range(int(max(flat)) + 1)]
    for i, b in enumerate(flat):
        out[b].append(i)
    return out


def pack_cells(items: DataFrame, capacity: int = CAPACITY, log: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """(cell, item, length) to (cell, item, bin, offset, fill): the best individual of each cell after EPOCHS epochs.

    log(epoch, islands) is given after each epoch what each (cell, island, place) has: bins, the generations that ran,
    how many individuals came in (the island's own and the migrants).
    """
    cells = items.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("x"))
    cells = stored(cells.select("cell", F.col("x.length").alias("size"), F.col("x.item").alias("items")), "cells")
    islands = cells.select("cell", "size", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    # a cell is a few kilobytes and tenths of a second: islands are dealt out, a few dozen to a task
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, cells.count() * ISLANDS // 32)

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for x in batch.itertuples():
                    size = [int(s) for s in x.size_]
                    came = [_unflat(m) for m in x.people] if number else None
                    # few enough to be kept whole: the island's own and its neighbour's best
                    found, generations = evolve(size, capacity, hash((x.cell, x.island, number)), came)
                    for place, own in enumerate(found[: POPULATION if number + 1 < EPOCHS else 1]):
                        rows.append((x.cell, x.island, place, *fitness(own, size, capacity), _flat(own, len(size)), generations, len(came or ())))
                yield pd.DataFrame(rows, columns=["cell", "island", "place", "bins", "unevenness", "individual", "generations", "arrived"])

        return run

    kind = "cell long, island int, place int, bins int, unevenness double, individual array<int>, generations int, arrived int"
    people = None
    for number in range(EPOCHS):
        start = islands.withColumnRenamed("size", "size_")
        if people is not None:
            # the elite goes to the next island as well; islands that have reached the bound are done
            moved = people.where("place = 0").withColumn("island", (F.col("island") + 1) % ISLANDS)
            pool = people.unionByName(moved).groupBy("cell", "island").agg(F.collect_list("individual").alias("people"))
            start = start.join(pool, ["cell", "island"])
        else:
            start = start.withColumn("people", F.array().cast("array<array<int>>"))
        new = stored(start.repartition(tasks, "cell", "island").mapInPandas(epoch(number), kind), "islands")
        if log:
            log(number, new)
        if people is not None:
            drop_stored(people)
        people = new
    best = people.where("place = 0").groupBy("cell").agg(F.min(F.struct("bins", "unevenness", "island", "individual"))["individual"].alias("bin"))
    rows = cells.join(best, "cell").select("cell", F.explode(F.arrays_zip("items", "size", "bin")).alias("x")).select("cell", F.col("x.items").alias("item"), F.col("x.size").alias("length"), F.col("x.bin").alias("bin"))

    own = Window.partitionBy("cell", "bin")
    rows = rows.withColumn("offset", F.sum("length").over(own.orderBy("item")) - F.col("length")).withColumn("fill", F.sum("length").over(own))
    out = stored(rows.select("cell", "item", "bin", F.col("offset").cast("long").alias("offset"), F.col("fill").cast("long").alias("fill"), "length"), "packed")
    drop_stored(people)
    drop_stored(cells)
    return out


def pack_documents(documents: DataFrame, tokenizer: str, *, end_id: int, capacity: int = CAPACITY, kept_pieces: int = KEPT_PIECES, log: Callable[[int, DataFrame], None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text (null: empty) and end_id; longer ones than `capacity` are cut into pieces of
    that many ids. Repeated rows are packed each for itself; a null id passes; an empty table gives no row. Other columns
    are not read. kept_pieces bounds the encoder's table in a worker, `log` is that of pack_cells.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, task, seen = encoder(tokenizer, "dropped", kept_pieces), TaskContext.get().partitionId(), 0
        for docs_of, texts in text_groups(batches):
            rows = []
            for doc, data in zip(docs_of, code.encode(texts), strict=True):
                ids = np.append(np.frombuffer(data, code.kind), code.kind.type(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    rows.append((doc, k, a, len(part), ids_crc32(part), (task << 24) + seen // CELL, seen % CELL))
                    seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "cell", "item"])
        release()

    docs = documents.select(documents[id_col].alias("id"), whole(documents[text_col]).alias("text"))
    kinds = [to_arrow_type(documents.schema[id_col].dataType), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    pieces = stored(docs.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, cell long, item int"), "pieces")
    first = pack_cells(pieces.select("cell", "item", F.col("length").cast("int").alias("length")), capacity, log)
    full = F.col("fill") >= WELL_FILLED * capacity
    # what is not well filled is dealt out evenly over new cells
    loose = first.where(~full)
    cells = -(-loose.count() // CELL)
    second = None
    if cells:
        own = loose.select(F.col("cell").alias("cell0"), F.col("item").alias("item0"), "length", F.pmod(F.xxhash64("cell", "item"), F.lit(cells)).alias("cell"))
        item = F.row_number().over(Window.partitionBy("cell").orderBy("cell0", "item0"))
        own = stored(own.withColumn("item", item), "loose")
        again = pack_cells(own.select("cell", "item", "length"), capacity, log)
        second = own.join(again, ["cell", "item"]).select(F.col("cell0").alias("cell"), F.col("item0").alias("item"), (-1 - F.col("cell") * (2 * CELL) - F.col("bin")).alias("sequence_id"), "offset")
    placed = first.where(full).select("cell", "item", (F.col("cell") * (2 * CELL) + F.col("bin")).alias("sequence_id"), "offset")
    if second is not None:
        placed = placed.unionByName(second)
    return pieces.join(placed, ["cell", "item"]).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


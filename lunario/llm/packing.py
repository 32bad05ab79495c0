"""Best-fit packing by a grouping genetic algorithm on islands.

Every document becomes its token ids and an end id. A document longer than a
sequence is cut into whole sequences from its end, so only its first piece may
be shorter. Whole sequences need no packing; the other pieces do.

Pieces are dealt to blocks of about ``BLOCK_PIECES``, every block getting about the
same mix of lengths from every partition. A block is packed
by several islands, each a task of its own with a population of packings. A
packing is a list of bins. Crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold a piece twice, and best-fits
the displaced pieces, largest first; mutation dissolves the emptiest bins and a
few others. After each epoch an island's elite moves on to the next island of
its block. Islands stop as soon as a packing reaches the lower bound of Martello
and Toth. When a block is packed, its emptiest bins that are not full are handed
on to the next level, whose blocks are fewer, down to one block; so what a block
cannot fill is filled with pieces of other blocks, and no task ever sees more
than a block.

Every random choice is drawn from a seed made of level, block, island and epoch:
a task that runs again gives the same packing.

Defined results: null and empty texts are a piece of the end id alone. Rows with
null or repeated doc_ids stay, each a document of its own. Very long texts are
encoded whole and cut into as many pieces as they need. Ties: a piece goes to
the fullest bin that takes it, of equal ones to the one last filled; islands
with equal packings give way to the lower number. An empty table gives no rows.
Other columns are not looked at.
"""

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.byte_bpe import ByteBpe
from lunario.llm.common import binary_values, in_worker, written

CAPACITY = 1024
END_ID = 2
BLOCK_PIECES = 8192
HANDED_ON = 4  # one bin of so many
ISLANDS = 3
EPOCHS = 2
POPULATION = 6
GENERATIONS = 24
ELITE = 2
TEXT_BYTES = 8 << 20  # of texts at once

# ---------------------------------------------------------------- pieces

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
def cut(length: int, capacity: int) -> list:
    """(start, length) of the pieces of a document: only the first may be shorter than ``capacity``."""
    head = length % capacity or capacity
    return [(0, min(head, length))] + [(at, capacity) for at in range(head, length, capacity)]


def _slices(batch):
    """Slices of a batch with at most ``TEXT_BYTES`` and one text each."""
    whole = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)) // TEXT_BYTES
    ends = [*np.flatnonzero(np.diff(whole)) + 1, batch.num_rows]
    return [batch.slice(low, high - low) for low, high in zip([0, *ends], ends)]


def _cut_documents(spec, end_id, capacity):
    def pieces(batches):
        # later tasks find the words that earlier ones have met
        coder = in_worker(("byte bpe", hash(spec.value)), lambda: ByteBpe(spec.value))
        end, width = end_id.to_bytes(coder.width, "little"), coder.width
        for batch in batches:
            for part in _slices(batch):
                rows = []
                coded = coder.encode(list(binary_values(part.column(1))))
                for doc_id, packed in zip(part.column(0).to_pylist(), coded):
                    packed += end
                    wide = np.frombuffer(packed, coder.kind).astype("<u4")
                    for k, (at, n) in enumerate(cut(len(wide), capacity)):
                        crc = zlib.crc32(wide[at : at + n].tobytes())
                        rows.append((doc_id, k, at, n, crc, packed[width * at : width * (at + n)]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [c.split()[0] for c in _PIECES.split(", ")]
                    )

    return pieces


def pieces_of(spark, docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, written: ``_PIECES`` and a number of their own, ``item``.

    ids holds the piece's ids as little-endian unsigned integers of two bytes, or
    four if the vocabulary has more than 65,536 ids.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut_documents(spec, end_id, capacity), _PIECES)
    out = written(made.withColumn("item", F.monotonically_increasing_id()), "pieces")
    spec.destroy()
    return out


# ---------------------------------------------------------------- one packing: the bin of every piece


def lower_bound(length: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: large pieces share no bin, small ones may only fill what they leave."""
    if not len(length):
        return 0
    count = np.bincount(length, minlength=capacity + 1)
    total = np.concatenate([[0], np.cumsum(count)])
    weight = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    half, best = capacity // 2, 0
    for k in range(half + 1):
        single = total[capacity + 1] - total[capacity - k + 1]
        pairs = total[capacity - k + 1] - total[half + 1]
        room = pairs * capacity - (weight[capacity - k + 1] - weight[half + 1])
        small = weight[half + 1] - weight[k]
        best = max(best, single + pairs + max(0, -(-(small - room) // capacity)))
    return int(best)


def best_fit(bin_of: np.ndarray, loose: np.ndarray, length: np.ndarray, capacity: int, weight=None) -> np.ndarray:
    """Put the ``loose`` pieces, largest ``weight`` (length) first, into the fullest bins that take them; bins are numbered anew."""
    kept = np.ones(len(bin_of), bool)
    kept[loose] = False
    used, numbered = np.unique(bin_of[kept], return_inverse=True)
    out = np.empty(len(bin_of), np.int32)
    out[kept] = numbered
    free = capacity - np.bincount(numbered, length[kept], len(used)).astype(np.int64)
    by_free = [[] for _ in range(capacity + 1)]
    open_bins = 0  # bit r: some bin has r places free
    # bins that not even the smallest piece fits into need not be listed
    listed = np.flatnonzero(free >= length[loose].min(initial=capacity))
    for number, room in zip(listed.tolist(), free[listed].tolist()):
        by_free[room].append(number)
    for room in np.unique(free[listed]).tolist():
        open_bins |= 1 << room
    bins = len(used)
    order = loose[np.argsort(-(length if weight is None else weight)[loose], kind="stable")]
    placed = []
    for size in length[order].tolist():
        fitting = open_bins >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = by_free[room].pop()
            if not by_free[room]:
                open_bins ^= 1 << room
        else:
            room, number, bins = capacity, bins, bins + 1
        placed.append(number)
        by_free[room - size].append(number)
        open_bins |= 1 << (room - size)
    out[order] = placed
    return out


def quality(bin_of, length, capacity):
    """(bins, -mean squared fill): less is better."""
    fill = np.bincount(bin_of, length) / capacity
    return len(fill), -float(np.mean(fill * fill))


def crossed(host, guest, length, capacity, rng):
    """Whole well-filled bins of ``guest`` in ``host``; bins that now hold a piece twice go, their other pieces are best-fitted."""
    fill = np.bincount(guest, length)
    well = fill >= np.median(fill)
    chosen = well & (rng.random(len(fill)) < 0.5)
    injected = chosen[guest]
    struck = np.zeros(host.max() + 1, bool)
    struck[host[injected]] = True
    loose = np.flatnonzero(struck[host] & ~injected)
    child = np.where(injected, guest + host.max() + 1, host)
    return best_fit(child, loose, length, capacity)


def mutated(bin_of, length, capacity, rng):
    """The emptiest bins and a few others dissolved, their pieces best-fitted in an order that is only roughly that of their size."""
    fill = np.bincount(bin_of, length)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[: 2 + len(fill) // 200]] = True
    # one other bin at least, as 2 % of few bins are none
    gone |= rng.random(len(fill)) < max(0.02, 1 / len(fill))
    return best_fit(bin_of, np.flatnonzero(gone[bin_of]), length, capacity, length * rng.uniform(0.7, 1.3, len(length)))


def evolved(length, capacity, rng, immigrants=()):
    """The best packings of a population, best first."""
    n, bound = len(length), lower_bound(length, capacity)

    def rated(packings):
        return [(*quality(p, length, capacity), p) for p in packings]

    def best(entries):
        # packings of one fitness count as one, or copies of the best soon fill the island
        unlike = {e[:2]: e for e in reversed(entries)}
        return [unlike[f] for f in sorted(unlike)]

    nothing, everything = np.zeros(n, np.int32), np.arange(n)
    population = best(rated(list(immigrants) or [best_fit(nothing, everything, length, capacity)]))
    if n == 0 or population[0][0] <= bound:
        return [p for *_, p in population[:ELITE]]
    starts = []
    while len(population) + len(starts) < POPULATION:
        # other starts: the pieces in an order that is only roughly that of their size
        starts.append(best_fit(nothing, everything, length, capacity, length * rng.uniform(0.7, 1.3, n)))
    population = best(population + rated(starts))
    for _ in range(GENERATIONS):
        first = population[0][2]
        children = [mutated(first, length, capacity, rng)]
        if len(population) > 1:
            a, b = (population[k][2] for k in sorted(rng.choice(len(population), 2, replace=False)))
            children += [crossed(a, b, length, capacity, rng), crossed(b, a, length, capacity, rng)]
        population = best(population + rated(children))[:POPULATION]
        if population[0][0] <= bound:
            break
    return [p for *_, p in population[:ELITE]]


# ---------------------------------------------------------------- islands and levels

_ELITES = "block long, island int, place int, bins int, fill double, packing binary"


def _epoch(capacity, level, epoch):
    def run(key, pieces: pd.DataFrame, immigrants: pd.DataFrame) -> pd.DataFrame:
        if pieces.empty:
            return pd.DataFrame({c.split()[0]: [] for c in _ELITES.split(", ")})
        block, island = map(int, key)
        length = pieces.sort_values("item")["length"].to_numpy(np.int64)
        rng = np.random.default_rng([level, block, island, epoch])
        came = [np.frombuffer(p, "<i4") for p in immigrants.sort_values(["island", "place"])["packing"]]
        rows = []
        for place, packing in enumerate(evolved(length, capacity, rng, came)):
            bins, fill = quality(packing, length, capacity)
            rows.append((block, island, place, bins, fill, packing.astype("<i4").tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _ELITES.split(", ")])

    return run


_PLACED = "item long, length int, sequence_id long, offset long, handed boolean"


def _placed(capacity, level, last):
    def run(key, pieces: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _PLACED.split(", ")]
        if pieces.empty:
            return pd.DataFrame({n: [] for n in names})
        pieces = pieces.sort_values("item").reset_index(drop=True)
        length = pieces["length"].to_numpy(np.int64)
        bin_of = np.frombuffer(best["packing"].iloc[0], "<i4")
        order = np.argsort(bin_of, kind="stable")
        fill = np.bincount(bin_of, length).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(fill)[:-1]])
        offset = np.empty(len(length), np.int64)
        offset[order] = np.concatenate([[0], np.cumsum(length[order])[:-1]])
        handed = np.zeros(len(fill), bool)
        if not last:
            emptiest = np.argsort(fill, kind="stable")[: -(-len(fill) // HANDED_ON)]
            handed[emptiest] = fill[emptiest] < capacity
        number = ((level << 28) + int(key[0]) << 24) + bin_of.astype(np.int64)
        columns = (pieces["item"], length, number, offset - starts[bin_of], handed[bin_of])
        return pd.DataFrame(dict(zip(names, columns)))

    return run


def _level(items, blocks, level, capacity):
    """One level: every block packed by its islands; ``_PLACED`` rows, written."""
    # neighbours by length go to different blocks, so that all blocks have about the same mix of lengths
    numbered = items.select("item", "length").sortWithinPartitions("length", "item").withColumn("n", F.monotonically_increasing_id())
    row, partition = F.col("n").bitwiseAND((1 << 33) - 1), F.shiftright("n", 33)
    block = F.pmod(row + F.xxhash64(partition, F.lit(level)) % 1_000_003, F.lit(blocks)).alias("block")
    dealt = written(numbered.select("item", "length", block), "blocks")
    island = F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island")
    crowd = dealt.select("*", island).groupBy("block", "island")
    elites = dealt.sparkSession.createDataFrame([], _ELITES)
    for epoch in range(EPOCHS):
        # the elite of an island moves on to the next one and joins its own
        moved = elites.withColumn("target", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
        moved = moved.unionByName(elites.withColumn("target", F.col("island"))) if epoch else moved
        met = crowd.cogroup(moved.groupBy("block", "target"))
        elites = written(met.applyInPandas(_epoch(capacity, level, epoch), _ELITES), "elites")
    best = elites.groupBy("block").agg(F.min_by("packing", F.struct("bins", "fill", "island", "place")).alias("packing"))
    placed = dealt.groupBy("block").cogroup(best.groupBy("block"))
    return written(placed.applyInPandas(_placed(capacity, level, blocks == 1), _PLACED), "placed")


def packed_items(items: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """(item, sequence_id, offset) of all ``items`` (item, length of less than ``capacity``)."""
    done, level, left = [], 0, items
    while True:
        blocks = max(1, math.ceil(left.count() / block_pieces))
        placed = _level(left, blocks, level, capacity)
        done.append(placed.where(~F.col("handed")).select("item", "sequence_id", "offset"))
        if blocks == 1:
            break
        left, level = placed.where("handed").select("item", "length"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packed(spark, docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its ids, its sequence and its place there."""
    pieces = pieces_of(spark, docs, vocabulary_path, end_id, capacity)
    whole = F.col("length") == capacity
    alone = pieces.where(whole).withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")})
    placed = packed_items(pieces.where(~whole).select("item", "length"), capacity)
    shared = pieces.where(~whole).join(placed, "item")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    return alone.select(*columns).unionByName(shared.select(*columns))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) with the ids of a sequence's pieces one after the other."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    gathered = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    return gathered.select("sequence_id", "n_tokens", joined.alias("ids"))


def op11_island_packing(spark, sf_dir):
    """Contract query over all of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = packed(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))
    return made.drop("ids").withColumn("length", F.col("length").cast("long"))

"""Product codes of vectors, their codebooks refined with Drake and Hamerly's adaptive bounds.

Components become integers, vectors are cut into equal consecutive parts, and
each part position has a codebook of its own, refined by a fixed number of rounds
of assignment and averaging. All distances, sums and averages are exact integers.

What a round learns about a part is kept for the next one, in the table that the
round writes: the entry it belongs to, the ``b`` next closest entries in order,
each with a lower bound of its distance, and one outer bound for all others. When
the entries have moved, a bound shrinks by the way its entry went, the outer one
by the longest way of all. The exact distance to the part's own entry, which is
computed anew, then shows how far down the list an entry could be closer: none
(the part stays), the first few (only they are computed) or, beyond the outer
bound, any (all are computed and the list is made anew). Bounds are rounded down
and must be passed by a margin, so every case that floating point could get wrong
counts as uncertain and is settled by integers, ties going to the lower index.
``b`` starts at ``LISTED`` and shrinks to what all but a few parts needed in the
last round, as counted over all of them.

The driver sees the codebooks (``entries`` times the vector length), their sums
by entry, and a histogram of at most ``LISTED`` + 2 rows a round. The table of a
round is removed when the next one has been written.

Defined results: vectors that are null or hold null or non-finite components are
dropped. All vectors that stay have the length of the one with the smallest
vec_id; those of another length are dropped, and a length that the parts do not
divide is filled up with zeros. Components beyond +-2**24 after scaling are held
there, so that no sum overflows. Rows with equal vec_id are ordered by their
components; null vec_ids come last. Repeated rows stay. Fewer vectors than
entries give a smaller codebook. Null labels are one label. An empty table gives
no rows. Other columns are not looked at.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.common import scratch_path, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LISTED = 24
LEAST_LISTED = 4
UNSERVED = 0.02  # share of the parts that the list may fail
LIMIT = 1 << 24
MARGIN = 1e-5

STATE = "vec_id long, label string, vector binary, own binary, listed binary, bounds binary, error long"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; vector: array<int> of floor(scale * x)."""
    doubles = F.col("embedding").cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(
        doubles, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * scale, F.lit(-2.0 * LIMIT)), F.lit(2.0 * LIMIT))), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    )
    taken = vectors.where(F.col("embedding").isNotNull() & finite)
    return taken.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), held.alias("vector"))


class Codebook:
    """Entries of all part positions and what is known of them: exact integers, kept as float64 where that is exact."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries  # parts x entries x components, int64
        self.norms = (entries * entries).sum(2)
        if before is not None:
            way = np.sqrt(((entries - before).astype(float) ** 2).sum(2)) * (1 + MARGIN)
            self.way, self.longest = way, way.max(1)

    def distances(self, part, rows):
        """Squared distances of rows (n x m, int64) to all entries of a part position, exact."""
        entries = self.entries[part]
        largest = max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0))
        if 4 * rows.shape[1] * float(largest) ** 2 < 2**52:  # products and sums are exact in float64
            cross = (rows.astype(float) @ entries.T.astype(float)).astype(np.int64)
        else:
            cross = rows @ entries.T
        return (rows * rows).sum(1)[:, None] - 2 * cross + self.norms[part]

    def some(self, part, rows, wanted):
        """Squared distances of rows to the ``wanted`` entries (n x k) of a part position, exact."""
        gap = rows[:, None, :] - self.entries[part][wanted]
        return (gap * gap).sum(2)


def _below(squared):
    """Roots rounded down to float32."""
    return np.nextafter((np.sqrt(squared.astype(float)) * (1 - MARGIN)).astype(np.float32), np.float32(-np.inf))


def _full(book, part, rows, b):
    """Own entry, its squared distance, the b next closest entries and their bounds with the outer one."""
    squared = book.distances(part, rows)
    k = squared.shape[1]
    near = min(b + 2, k)
    # by distance, ties by index: one integer orders both
    key = squared * k + np.arange(k)
    close = np.argpartition(key, near - 1, 1)[:, :near] if near < k else np.broadcast_to(np.arange(k), key.shape)
    order = np.take_along_axis(close, np.argsort(np.take_along_axis(key, close, 1), 1), 1)
    reach = np.take_along_axis(squared, order, 1)
    listed, bounds = np.full((len(rows), b), -1, np.int16), np.full((len(rows), b + 1), np.inf, np.float32)
    held = min(b, near - 1)
    listed[:, :held], bounds[:, :held] = order[:, 1 : held + 1], _below(reach[:, 1 : held + 1])
    if near == b + 2:
        bounds[:, b] = _below(reach[:, b + 1])
    return order[:, 0], reach[:, 0], listed, bounds


def _bounded(book, part, rows, own, listed, bounds):
    """The same from what the last round knew; also how many listed entries each part needed (b + 1: all entries)."""
    n, b = listed.shape
    there = listed >= 0
    bounds = bounds.copy()
    bounds[:, :b] -= np.where(there, book.way[part][listed], 0)
    bounds[:, b] -= book.longest[part]
    # a bound also holds for everything further down the list
    bounds = np.minimum.accumulate(bounds[:, ::-1], 1)[:, ::-1]
    mine = book.some(part, rows, own[:, None])[:, 0]
    passed = np.sqrt(mine.astype(float))[:, None] * (1 + MARGIN) < bounds
    need = np.where(passed.any(1), passed.argmax(1), b + 1)
    own, mine, listed = own.copy(), mine.copy(), listed.copy()
    few = np.flatnonzero((need > 0) & (need <= b))
    if len(few):
        width = int(need[few].max())
        candidates = listed[few, :width]
        asked = (np.arange(width) < need[few][:, None]) & (candidates >= 0)
        squared = book.some(part, rows[few], np.where(asked, candidates, 0))
        far = np.int64(1) << 54
        squared = np.concatenate([mine[few][:, None], np.where(asked, squared, far)], 1)
        names = np.concatenate([own[few][:, None], candidates], 1)
        k = book.entries.shape[1]
        order = np.argsort(squared * k + np.where(names >= 0, names, k - 1), 1, kind="stable")
        names, squared = np.take_along_axis(names, order, 1), np.take_along_axis(squared, order, 1)
        own[few], mine[few] = names[:, 0], squared[:, 0]
        # computed entries come in their new order, the others keep place and bound
        at = np.arange(width) < need[few][:, None]
        head, limit = listed[few, :width], bounds[few, :width]
        listed[few, :width] = np.where(at, names[:, 1:], head)
        bounds[few, :width] = np.where(at, np.where(squared[:, 1:] == far, np.float32(np.inf), _below(squared[:, 1:])), limit)
    every = np.flatnonzero(need == b + 1)
    if len(every):
        own[every], mine[every], listed[every], bounds[every] = _full(book, part, rows[every], b)
    return own, mine, listed, bounds, need


def _matrix(column, kind, rows):
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _rows_of(matrix, kind):
    flat, size = np.ascontiguousarray(matrix, kind).tobytes(), matrix.shape[1] * np.dtype(kind).itemsize
    return pa.array([flat[k * size : (k + 1) * size] for k in range(len(matrix))], pa.binary())


def _assign(shared, parts, b, keep):
    """Arrow batches of ``STATE`` under the codebook at hand; ``need`` counts go to a column of their own."""

    def run(batches):
        book = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part_of = batch.slice(low, 4096)
                n = part_of.num_rows
                vectors = _matrix(part_of["vector"], "<i4", n).astype(np.int64).reshape(n, parts, -1)
                first = part_of["own"][0].as_py() is None
                if not first:
                    owned = _matrix(part_of["own"], np.uint8, n).astype(np.int64)
                    was = _matrix(part_of["listed"], "<i2", n).reshape(n, parts, -1)
                    limits = _matrix(part_of["bounds"], "<f4", n).reshape(n, parts, -1)
                own, error, lists, bounds, needs = [], np.zeros(n, np.int64), [], [], []
                for p in range(parts):
                    rows = vectors[:, p]
                    if first:
                        mine, squared, near, bound = _full(book, p, rows, b)
                    else:
                        # a shorter list: what falls off it is covered by the outer bound
                        outer = limits[:, p, b:].min(1, keepdims=True)
                        limit = np.concatenate([limits[:, p, :b], outer], 1)
                        mine, squared, near, bound, need = _bounded(book, p, rows, owned[:, p], was[:, p, :b], limit)
                        needs.append(need)
                    own.append(mine), lists.append(near), bounds.append(bound)
                    error += squared
                used = np.stack(needs, 1) if needs else np.zeros((n, parts))
                columns = [part_of["vec_id"], part_of["label"], part_of["vector"], _rows_of(np.stack(own, 1), np.uint8)]
                if keep:
                    columns += [
                        _rows_of(np.concatenate(lists, 1), "<i2"),
                        _rows_of(np.concatenate(bounds, 1), "<f4"),
                        pa.array(error),
                        _rows_of(used, np.uint8),
                    ]
                else:
                    columns += [pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(error), _rows_of(used, np.uint8)]
                yield pa.RecordBatch.from_arrays(columns, [*[c.split()[0] for c in STATE.split(", ")], "needed"])

    return run


def _sums(parts, entries):
    """Counts and component sums of the parts by (part, entry) and place; place -1 holds the count."""

    def run(batches):
        total = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = _matrix(batch["vector"], "<i4", n).astype(np.int64).reshape(n, parts, -1)
            own = _matrix(batch["own"], np.uint8, n)
            if total is None:
                total = np.zeros((parts, entries, vectors.shape[2] + 1), np.int64)
            for p in range(parts):
                order = np.argsort(own[:, p], kind="stable")
                who, at = np.unique(own[order, p], return_index=True)
                total[p, who, 1:] += np.add.reduceat(vectors[order, p], at, 0)
                total[p, who, 0] += np.diff([*at, n])
        if total is not None:
            p, e, place = np.nonzero(total)
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(place - 1, pa.int32()), pa.array(total[p, e, place])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "total"])

    return run


def _averaged(state, entries):
    """The codebooks after one averaging: floor(sum / count), unused entries as they were."""
    parts, k, width = entries.shape
    found = state.select("vector", "own").mapInArrow(_sums(parts, k), "part int, entry int, place int, total long")
    rows = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((parts, k, width + 1), np.int64)
    for part, entry, place, value in rows:
        total[part, entry, place + 1] = value
    count = total[:, :, :1]
    return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), entries)


def _enough(state, b, parts):
    """The shortest list that would have served all but ``UNSERVED`` of the parts in this round."""
    counted = state.select(F.explode(F.array(*[F.conv(F.hex(F.expr(f"substring(needed, {p + 1}, 1)")), 16, 10).cast("int") for p in range(parts)])).alias("need"))
    seen = dict(counted.groupBy("need").count().collect())
    beyond = 0
    for need in range(b + 1, LEAST_LISTED, -1):
        # parts beyond the outer bound need all entries whatever the length
        beyond += seen.get(need, 0) if need <= b else 0
        if beyond > UNSERVED * sum(seen.values()):
            return min(b, need)
    return min(b, LEAST_LISTED)


def _discard(path):
    """Remove a round's table once the next one has been written."""
    store, inside = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    store.delete_dir(inside)


class Codes:
    """``rows`` (vec_id, label, code, error) and the ``codebooks`` (parts x entries x components) behind them."""

    def __init__(self, rows, codebooks):
        self.rows, self.codebooks = rows, codebooks

    def digest(self):
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, listed: int = LISTED) -> Codes:
    """Codes of all usable rows of ``vectors`` (vec_id, embedding, label); at most 256 entries."""
    spark = vectors.sparkSession
    taken = integer_vectors(vectors)
    smallest = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    start = taken.orderBy(*smallest).limit(entries).collect()
    if not start:
        rows = spark.createDataFrame([], "vec_id long, label string, code string, error long")
        return Codes(rows, np.zeros((parts, 0, 0), np.int64))
    size = len(start[0]["vector"])
    taken = taken.where(F.size("vector") == size)
    if any(len(r["vector"]) != size for r in start):
        start = taken.orderBy(*smallest).limit(entries).collect()
    width = -(-size // parts)
    filled = [r["vector"] + [0] * (width * parts - size) for r in start]
    codebooks = np.array(filled, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    zeros = F.array_repeat(F.lit(0), width * parts - size)
    # little-endian 32-bit integers, one after the other
    packed = taken.select("vec_id", "label", F.concat("vector", zeros).alias("vector")).mapInArrow(_packed, "vec_id long, label string, vector binary")
    empty = F.lit(None).cast("binary")
    state = packed.select("*", empty.alias("own"), empty.alias("listed"), empty.alias("bounds"), F.lit(0).cast("long").alias("error"))
    b, before, path = max(1, min(listed, len(start) - 1)), None, None
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Codebook(codebooks, before))
        columns = [c.split()[0] for c in STATE.split(", ")]
        made = state.select(*columns).mapInArrow(_assign(shared, parts, b, turn < rounds), f"{STATE}, needed binary")
        old, path = path, scratch_path(spark, "vector-state")
        made.write.parquet(path)
        shared.destroy()
        state = spark.read.schema(f"{STATE}, needed binary").parquet(path)
        if old:
            _discard(old)
        if turn < rounds:
            if turn:
                b = _enough(state, b, parts)
            before, codebooks = codebooks, _averaged(state, codebooks)
    code = F.lower(F.hex("own"))
    return Codes(state.select("vec_id", "label", code.alias("code"), "error"), codebooks)


def _packed(batches):
    for batch in batches:
        column = batch["vector"]
        values = column.flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], _rows_of(values, "<i4")], ["vec_id", "label", "vector"])


def op13_adaptive_bound_codes(spark, sf_dir):
    """Contract query over all of ``embeddings``."""
    codes = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    totals = written(codes.rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    kind = F.struct(F.col("label").isNull().alias("missing"), F.coalesce("label", F.lit("")).alias("name"))
    rows = codes.rows.select("vec_id", "code", "error", kind.alias("kind"))
    joined = rows.join(totals.select("label_error", kind.alias("kind")), "kind")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def _round_sql(turn):
    """Assignment under codebook ``turn`` and the next codebook."""
    return f"""
a{turn} AS MATERIALIZED (
    SELECT q.row, q.part, min(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + c.entry) AS best
    FROM cut q JOIN c{turn} c USING (part) GROUP BY ALL),
m{turn} AS MATERIALIZED (
    SELECT part, entry, list(floor(total / n)::BIGINT ORDER BY place) AS v FROM (
        SELECT part, best % 256 AS entry, place, sum(x) AS total, count(*) AS n
        FROM (SELECT q.part, a.best, unnest(q.v) AS x, unnest(range(len(q.v))) AS place FROM cut q JOIN a{turn} a USING (row, part))
        GROUP BY ALL) GROUP BY ALL),
c{turn + 1} AS MATERIALIZED (
    SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{turn} c LEFT JOIN m{turn} m USING (part, entry))"""


OP13_SQL = f"""
WITH ints AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v,
        row_number() OVER (ORDER BY vec_id) - 1 AS row
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
    SELECT row, p AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v
    FROM ints, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT part, row AS entry, v FROM cut WHERE row < {ENTRIES}),
{",".join(_round_sql(turn) for turn in range(ROUNDS))},
last AS MATERIALIZED (
    SELECT q.row, q.part, min(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + c.entry) AS best
    FROM cut q JOIN c{ROUNDS} c USING (part) GROUP BY ALL),
coded AS MATERIALIZED (
    SELECT row, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
    FROM last GROUP BY ALL),
books AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM ints JOIN coded USING (row), books
"""

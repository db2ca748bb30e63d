r"""Ranking with ties inside groups through a bit-sliced bitmap index.

Lines are ranked within groups by a pair key; `top_places` returns every line
whose place (1 plus the lines of its group with earlier keys) is at most a given
number, tied lines included.

1. Index. Lines are dealt to partitions by group; a group with more lines than a
   cell holds is salted, so that it spreads over as many cells as it fills. Each
   partition writes blocks. A block has, for every bit of the key columns (a bit
   for not null, then the 64 bits of the distance from the least value, largest
   first), a bitmap over its lines, and a bitmap for every group: lines stand in order of group, so that
   one is a run, kept by its start. Bitmaps that are all zeros or ones are left
   out. What else is to be returned of a line is kept in the block by place.
2. Cutoff. Bit by bit, popcounts of (group AND candidates AND NOT bit), summed
   over the partitions, say whether the wanted line has a 0 there: then the
   candidates with a 1 fall away, else those with a 0 are all earlier and leave
   so many fewer to find. The last candidates have the cutoff key exactly. A
   group that lies in one block is finished there, its sum having one term. For
   the others every bit is a round: the popcounts of their blocks are summed by
   group and joined back. Only bits that differ among their lines take a round.
3. Lines. Blocks give the lines up to the cutoff. Lines of spread groups become
   one row for equal ones with a count, and are numbered through range partitions
   and the counts of those.

Nothing of the lines comes to the driver but their number, the least keys and the
popcounts of each bit over all blocks (65 for each key column), and nothing is broadcast on purpose. No
step holds more than a block in Python or sorts a whole group in one task.

Defined results: nulls in group columns form groups of their own; null keys come
first and are equal to each other; nulls of the order within a key come last.
Equal lines each get a row and a position. An empty table gives no rows. Other
columns are ignored, and the caller's names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Lines of a block; of a cell, at most, and at least.
BLOCK, CELL, LEAST_CELL = 16_384, 50_000, 1_000
#: Bits of a key column: whether it is not null, then how far it is above the column's least value.
BITS = 65
#: Lines of a partition of the index, on average at most: more lines than the session's shuffle partitions hold get more partitions.
PART_LINES = 200_000
#: Copies of a line that one row makes at once.
COPIES = 10_000


def _bits(values: np.ndarray, valid: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """The slices of a key column, as booleans, largest bit first."""
    yield valid
    ordered = np.where(valid, values - np.int64(least), 0).view(np.uint64)
    for j in range(63, -1, -1):
        yield (ordered >> np.uint64(j) & np.uint64(1)).astype(bool)


def _column(array: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 for null, and whether they are there."""
    return array.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), ~array.is_null().to_numpy(zero_copy_only=False)


class _Shape:
    """Column names of `groups` group, `pair` key and `then` order columns, and the schemas made of them."""

    def __init__(self, groups: int, pair: int, then: int):
        self.g, self.p, self.t = ([f"{c}{i}" for i in range(n)] for c, n in (("g", groups), ("p", pair), ("t", then)))
        #: The least value of each key column.
        self.least = [0] * pair
        self.lines = ", ".join(f"{c} long" for c in self.g + self.p + self.t)
        arrays = ", ".join(f"{c} array<long>" for c in self.g + self.t)
        self.blocks = f"spread boolean, n int, starts array<int>, ones array<int>, slices array<binary>, {arrays}"
        self.groups = ", ".join(f"{c} long" for c in self.g)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        self.block_schema = pa.schema([("spread", pa.bool_()), ("n", pa.int32()), ("starts", ints), ("ones", ints), ("slices", pa.list_(pa.binary())), *[(c, longs) for c in self.g + self.t]])

    def same(self, left: str, right: str) -> Column:
        """That the group columns of two tables are equal, nulls being equal to nulls."""
        return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in self.g])


def build_index(lines: DataFrame, shape: _Shape, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """The written index over `lines` (columns g*, p*, t*): a row for each block of several whole groups, and for each part of a spread group."""
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, *least = lines.agg(F.count("*"), *[F.min(p) for p in shape.p]).first()
    shape.least = [v or 0 for v in least]
    parts = max(parts, -(-n // PART_LINES))
    cell = max(min(cell, n // (4 * parts)), min(cell, LEAST_CELL))
    large = materialise(lines.groupBy(*shape.g).agg(F.count("*").alias("held")).filter(f"held > {cell}"), "rank-spread-groups")
    numbered = lines.withColumn("nth", F.monotonically_increasing_id())
    met = numbered.alias("l").join(large.alias("s"), shape.same("l", "s"), "left")
    salt = F.when(F.col("held").isNull(), 0).otherwise(F.expr(f"nth % ((held + {cell - 1}) div {cell})"))
    dealt = met.select("l.*", F.col("held").isNotNull().alias("spread"), F.xxhash64(*[f"l.{c}" for c in shape.g], salt).alias("cell"))
    ordered = dealt.repartition(parts, "cell").sortWithinPartitions("spread", *shape.g)

    def row(table: pa.Table, spread: bool, starts: np.ndarray) -> pa.RecordBatch:
        n, ones, slices = len(table), [], []
        for p, least in zip(shape.p, shape.least, strict=True):
            for bit in _bits(*_column(table[p]), least):
                ones.append(int(np.count_nonzero(bit)))
                slices.append(np.packbits(bit).tobytes() if 0 < ones[-1] < n else None)
        groups = [table[g].take(pa.array(starts)).to_pylist() for g in shape.g]
        then = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table[t].combine_chunks().cast(pa.int64())) for t in shape.t]
        columns = [pa.array([v], f.type) for v, f in zip([spread, n, starts, ones, slices, *groups], shape.block_schema, strict=False)]
        return pa.RecordBatch.from_arrays([*columns, *then], schema=shape.block_schema)

    def changes(table: pa.Table) -> np.ndarray:
        """Where groups begin, with those that are spread after the others."""
        new = np.zeros(len(table), bool)
        new[0] = True
        for c in ["spread", *shape.g]:
            values, valid = _column(table[c])
            new[1:] |= (values[1:] != values[:-1]) | (valid[1:] != valid[:-1])
        return np.flatnonzero(new)

    def blocks_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = changes(table)
        spread = table["spread"].to_numpy(zero_copy_only=False).astype(bool)[starts]
        whole = starts[~spread]
        if len(whole):
            upto = int(starts[len(whole)]) if spread.any() else len(table)
            yield row(table.slice(0, upto), False, whole)
        ends = [*starts.tolist()[1:], len(table)]
        for i in np.flatnonzero(spread).tolist():
            yield row(table.slice(int(starts[i]), ends[i] - int(starts[i])), True, np.zeros(1, np.int64))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n < block:
                continue
            table = pa.Table.from_batches(held)
            # A group that is not spread stays whole: the last one may go on in the next batch.
            cut = n if table["spread"][-1].as_py() else int(changes(table)[-1])
            if cut:
                yield from blocks_of(table.slice(0, cut))
                held, n = table.slice(cut).combine_chunks().to_batches(), n - cut
        if n:
            yield from blocks_of(pa.Table.from_batches(held))

    return materialise(ordered.select("spread", *shape.g, *shape.p, *shape.t).mapInArrow(build, shape.blocks), "rank-index", "zstd")


def _unpacked(row: dict, s: int) -> np.ndarray:
    """Slice `s` of a block, as booleans."""
    if row["slices"][s] is None:
        return np.full(row["n"], row["ones"][s] > 0)
    return np.unpackbits(np.frombuffer(row["slices"][s], np.uint8), count=row["n"]).astype(bool)


def _keys(row: dict, at: np.ndarray, shape: _Shape) -> list[tuple[np.ndarray, np.ndarray]]:
    """The key columns of the lines at the given places of a block, from its slices: values and whether they are there."""
    found = []
    for k, least in enumerate(shape.least):
        first, *rest = (_unpacked(row, k * BITS + j)[at] for j in range(BITS))
        ordered = np.zeros(len(at), np.uint64)
        for j, bit in enumerate(rest):
            ordered |= bit.astype(np.uint64) << np.uint64(63 - j)
        found.append((np.where(first, ordered.view(np.int64) + np.int64(least), 0), first))
    return found


def _array(values: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=~valid)


def _rows(batch: pa.RecordBatch, then: list[str]) -> Iterator[tuple[dict, list[pa.Array]]]:
    """Each block of a batch: its fields, and its order columns as arrays."""
    names = [c for c in batch.schema.names if c not in then]
    for i in range(batch.num_rows):
        yield {c: batch[c][i].as_py() for c in names}, [batch[c][i].values for c in then]


def whole_groups(index: DataFrame, shape: _Shape, places: int) -> DataFrame:
    """g*, pos, place, p*, t* and tied of the lines wanted, of the groups that lie in one block."""
    out = ["pos", "place", *shape.p, *shape.t, "tied"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, then in _rows(batch, shape.t):
                n, starts = row["n"], np.array(row["starts"], np.int64)
                of = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
                candidates, earlier, left = np.ones(n, bool), np.zeros(n, bool), np.full(len(starts), places)
                for s, ones in enumerate(row["ones"]):
                    if 0 < ones < n:
                        bit = _unpacked(row, s)
                        zeros = candidates & ~bit
                        counts = np.add.reduceat(zeros.astype(np.int64), starts)
                        low = counts >= left
                        left = left - np.where(low, 0, counts)
                        below = low[of]
                        earlier |= zeros & ~below
                        candidates &= ~bit ^ ~below
                at = np.flatnonzero(earlier | candidates)
                keys, group = _keys(row, at, shape), of[at]
                others = [_column(t.take(pa.array(at))) for t in then]
                order = np.lexsort([x for values, valid in reversed(others) for x in (values, ~valid)] + [x for values, valid in reversed(keys) for x in (values, valid)] + [group])
                at, group, keys, others = at[order], group[order], [(v[order], k[order]) for v, k in keys], [(v[order], k[order]) for v, k in others]
                number = np.arange(len(at))
                new_group = np.append(True, group[1:] != group[:-1])
                new_key = new_group.copy()
                for values, valid in keys:
                    new_key[1:] |= (values[1:] != values[:-1]) | (valid[1:] != valid[:-1])
                first = np.maximum.accumulate(np.where(new_group, number, 0))
                run = np.cumsum(new_key) - 1
                pos, place = number - first + 1, np.flatnonzero(new_key)[run] - first + 1
                every = np.ones(len(at), bool)
                groups = [pa.array(row[g], pa.int64()).take(pa.array(group)) for g in shape.g]
                columns = [*groups, _array(pos, every), _array(place, every), *[_array(*k) for k in keys], *[_array(*o) for o in others], _array(np.bincount(run)[run], every)]
                yield pa.RecordBatch.from_arrays(columns, names=shape.g + out)

    wanted = index.filter("NOT spread").select("n", "starts", "ones", "slices", *shape.g, *shape.t)
    return wanted.mapInArrow(finish, f"{shape.groups}, " + ", ".join(f"{c} long" for c in out))


def _matching(row: dict, slices: list[int], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a block whose bits in `slices` are `path`, and those that have a 0 where they first differ; packed."""
    candidates, earlier = np.packbits(np.ones(row["n"], bool)), np.zeros((row["n"] + 7) // 8, np.uint8)
    for s, want in zip(slices, path, strict=False):
        bit = np.frombuffer(row["slices"][s], np.uint8) if row["slices"][s] is not None else np.full(len(earlier), 255 * (row["ones"][s] > 0), np.uint8)
        if want == "1":
            earlier |= candidates & ~bit
            candidates = candidates & bit
        else:
            candidates = candidates & ~bit
    return candidates, earlier


def spread_cutoffs(parts: DataFrame, shape: _Shape, places: int) -> tuple[DataFrame, list[int]]:
    """(g*, path) of the spread groups, path being the cutoff's bits in the slices that differ, and those slices."""
    counts = parts.select("n", F.posexplode("ones").alias("s", "one")).groupBy("s").agg(F.sum("one").alias("one"), F.sum("n").alias("n"))
    differ = sorted(r.s for r in counts.filter("one > 0 AND one < n").collect())  # at most BITS rows for each key column
    state = parts.select(*shape.g).distinct().select("*", F.lit(places).cast("long").alias("left_to_find"), F.lit("").alias("path"))
    for i, s in enumerate(differ):
        slices = differ[: i + 1]

        def popcounts(batches: Iterator[pa.RecordBatch], slices: list[int] = slices) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                zeros = []
                for row, _ in _rows(batch.select(["n", "ones", "slices", "path"]), []):
                    zeros.append(int(np.bitwise_count(_matching(row, slices, row["path"] + "0")[0]).sum()))
                yield pa.RecordBatch.from_arrays([*[batch[g] for g in shape.g], pa.array(zeros, pa.int64())], names=[*shape.g, "zeros"])

        state = materialise(state, f"rank-bit-{s}")
        met = parts.alias("b").join(state.alias("s"), shape.same("b", "s")).select("b.n", "b.ones", "b.slices", "s.path", *[f"b.{g}" for g in shape.g])
        summed = met.mapInArrow(popcounts, f"{shape.groups}, zeros long").groupBy(*shape.g).agg(F.sum("zeros").alias("zeros"))
        low = F.col("zeros") >= F.col("left_to_find")
        joined = state.alias("s").join(summed.alias("c"), shape.same("s", "c"))
        state = joined.select(*[f"s.{g}" for g in shape.g], F.when(low, F.col("left_to_find")).otherwise(F.col("left_to_find") - F.col("zeros")).alias("left_to_find"), F.concat("path", F.when(low, "0").otherwise("1")).alias("path"))
    return materialise(state.select(*shape.g, "path"), "rank-cutoffs"), differ


def spread_groups(index: DataFrame, shape: _Shape, places: int) -> DataFrame:
    """As `whole_groups`, of the groups that lie in several blocks."""
    spark = index.sparkSession
    parts = index.filter("spread").select("n", "ones", "slices", *[F.element_at(g, 1).alias(g) for g in shape.g], *shape.t)
    cutoffs, differ = spread_cutoffs(parts.drop(*shape.t), shape, places)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, then in _rows(batch, shape.t):
                candidates, earlier = _matching(row, differ, row["path"])
                at = np.flatnonzero(np.unpackbits(candidates | earlier, count=row["n"]))
                keys = [_array(*k) for k in _keys(row, at, shape)]
                groups = [pa.array([row[g]], pa.int64()).take(pa.array(np.zeros(len(at), np.int64))) for g in shape.g]
                yield pa.RecordBatch.from_arrays([*groups, *keys, *[t.take(pa.array(at)) for t in then]], names=shape.g + shape.p + shape.t)

    met = parts.alias("b").join(cutoffs.alias("c"), shape.same("b", "c")).select("b.*", "c.path")
    line = [*shape.g, *shape.p, *shape.t]
    equal = materialise(met.mapInArrow(fetch, shape.lines).groupBy(*line).agg(F.count("*").alias("copies")), "rank-fetched")

    by_key = [F.col(c).asc_nulls_first() for c in shape.g + shape.p]
    order = [*by_key, *[F.col(c).asc_nulls_last() for c in shape.t]]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, upto = None, 0
        for batch in batches:
            before = []
            for *now, copies in zip(*(batch[c].to_pylist() for c in [*shape.g, *shape.p, "copies"]), strict=True):
                if now != key:
                    key, upto = now, 0
                before.append(upto)
                upto += copies
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "before"])

    ranged = equal.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("nth", F.spark_partition_id().cast("long"))
    numbered = materialise(ranged.mapInArrow(number, f"{shape.lines}, copies long, nth long, before long"), "rank-numbered")
    # A row for each range partition that a key reaches into; of a group's keys there are `places` at most.
    runs = numbered.groupBy(*shape.g, *shape.p, "nth").agg(F.sum("copies").alias("n"))
    key = W.partitionBy(*shape.g, *shape.p)
    runs = runs.select("*", F.sum("n").over(key).alias("tied"), F.coalesce(F.sum("n").over(key.orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("runs_before"))
    keys = runs.groupBy(*shape.g, *shape.p).agg(F.first("tied").alias("n"))
    group = W.partitionBy(*shape.g).orderBy(*[F.col(p).asc_nulls_first() for p in shape.p])
    keys = keys.select("*", (F.coalesce(F.sum("n").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).alias("place"))
    equals = lambda a, b, more: reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*shape.g, *shape.p, *more]])
    placed = runs.alias("r").join(keys.alias("k"), equals("r", "k", [])).select("r.*", "k.place")
    found = numbered.alias("l").join(placed.alias("r"), equals("l", "r", ["nth"])).select("l.*", "r.tied", "r.place", "r.runs_before")
    # Copies are dealt in portions, so that those of one line are made in many tasks.
    some = found.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    some = some.repartition(n, "start", *line)
    each = some.withColumn("copy", F.explode(F.sequence("start", F.least(F.col("start") + COPIES, "copies") - 1)))
    return each.select(*shape.g, F.expr("place + runs_before + before + copy").alias("pos"), "place", *shape.p, *shape.t, "tied")


def top_places(df: DataFrame, groups: dict[str, Column], pair: dict[str, Column], then: dict[str, Column], places: int, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Lines with a place of at most `places`: the columns of `groups`, pos, place, those of `pair` and `then`, and tied.

    All three name columns of type long. Within a group lines come in order of `pair` (smallest and nulls first), then of
    `then` (smallest first, nulls last): pos counts them from 1. tied counts the lines of the group with the same pair.
    """
    shape = _Shape(len(groups), len(pair), len(then))
    named = zip([*shape.g, *shape.p, *shape.t], [*groups.values(), *pair.values(), *then.values()], strict=True)
    lines = df.select(*[c.cast("long").alias(name) for name, c in named])
    index = build_index(lines, shape, cell, block)
    found = whole_groups(index, shape, places).unionByName(spread_groups(index, shape, places))
    out = dict(zip([*shape.g, "pos", "place", *shape.p, *shape.t, "tied"], [*groups, "pos", "place", *pair, *then, "tied"], strict=True))
    return found.select(*[F.col(c).alias(name) for c, name in out.items()])


PLACES = 3


def op11_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percents and cents of values that are no numbers count as null."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet")
    hundredths = lambda c: F.when(~F.isnan(c), F.floor(F.lit(100) * F.col(c) + F.lit(0.5)))
    one = F.col("sale_id").isNotNull() & (F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0)
    apart = lambda c: F.when(one, F.lit(-1)).otherwise(c)
    month = F.lit(100) * F.year("shipped_at") + F.month("shipped_at")
    groups = {"vendor_id": apart(F.col("vendor_id")), "part": apart(F.coalesce(F.col("item_id") % 10, F.lit(-1))), "month": apart(F.coalesce(month, F.lit(-1)))}
    pair = {"tens": -F.floor(F.col("quantity") / 10), "percent": hundredths("discount")}
    then = {"sale_id": F.col("sale_id"), "line_no": F.col("line_no"), "quantity": F.col("quantity"), "amount_cents": hundredths("amount")}
    return top_places(lines, groups, pair, then, PLACES).select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


ORACLE_SQL = f"""
WITH ids AS (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL),
crc AS (
  -- the checksum of the decimal text: a number of 0 or more is a byte to take in, -1 a step of one bit
  SELECT sale_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(sale_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) WHEN h % 2 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)) AS crc FROM ids),
l AS (
  SELECT crc IS NOT NULL AND crc % 5 = 0 AS one, s.vendor_id, coalesce(item_id % 10, -1) AS part, coalesce(100 * year(shipped_at) + month(shipped_at), -1) AS month, s.sale_id, line_no::BIGINT AS line_no,
    quantity::BIGINT AS quantity, floor(quantity / 10)::BIGINT AS tens, CASE WHEN NOT isnan(discount) THEN floor(100 * discount + 0.5)::BIGINT END AS percent, CASE WHEN NOT isnan(amount) THEN floor(100 * amount + 0.5)::BIGINT END AS amount_cents
  FROM sale_lines s LEFT JOIN crc ON s.sale_id = crc.sale_id),
g AS (SELECT CASE WHEN one THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN one THEN -1 ELSE part END AS part, CASE WHEN one THEN -1 ELSE month END AS month, sale_id, line_no, quantity, tens, percent, amount_cents FROM l),
r AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
    rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST) AS place, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied
  FROM g)
SELECT vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE place <= {PLACES}"""

"""Most similar vectors for every vector, by multi-index hashing.

Per group of comparable vectors (one model, one dimension) several rotations are
learned on a bounded sample (PCA, then iterative quantization from different
starts). The signs of the rotated vectors are one long binary code, cut into m
substrings of s bits, each the key of its own index. A vector probes every index
with its substring and all substrings one bit away, so by the pigeonhole principle
every code within m * 2 - 1 bits is met, and most codes well beyond that. A 64-bit
sketch of the code drops accidental hits; then bytes with a bound of their error drop
what cannot reach the cosine; what remains is ranked by the floats.

The vectors of one substring, cut by its first bits where they are many, lie in one
task, which meets them in memory; so a row is shuffled once or a few times a
substring, not once for each neighbour. Substrings are taken in passes, and the floats
of pairs too, and what a pass shuffled is removed at its end: the disk follows the
vectors, not the number of substrings or candidates.

Exact copies are one class with one code; ranks are expanded to their members at
the end. A bucket with more than HOT_BUCKET vectors is not joined row by row: its
vectors are compared in blocks, and each block gives only the k best per query.

Defined results: null or empty vectors, and those with null, NaN or infinite
entries or of zero length, have no neighbours; equal cosines rank by smaller id;
repeated rows count once; vectors of different groups or dimensions never meet.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Rows per group on which rotations are learned, and rows of all groups together.
SAMPLE_ROWS = 4096
SAMPLE_TOTAL = 65_536
#: Vectors of a bucket beyond which it is compared in blocks of this size.
HOT_BUCKET = 2_000
#: Hot buckets that are sent to every executor; more are joined by shuffle.
HOT_BROADCAST = 50_000
#: Bytes of one substring's rows that one task shall hold.
PART_BYTES = 48_000_000
#: A pass may shuffle this many bytes, or this many times the vectors if that is more.
PASS_BYTES = 128_000_000
PASS_SHARE = 1.25
#: Bytes of vectors that are coded at once, pairs of rows that are compared at once.
CODE_BYTES = 16_000_000
PAIRS_AT_ONCE = 1_000_000


def learn_rotations(sample: np.ndarray, bits: int, seed: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of ``bits`` columns: PCA axes turned by learned rotations."""
    dim = sample.shape[1]
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False) if len(sample) >= dim else (0, 0, np.eye(dim))
    reduced = centred @ axes.T
    rng = np.random.default_rng(seed)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        for _ in range(rounds if len(sample) >= dim else 0):
            signs = np.where(reduced @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ reduced)
            turn = (left @ right).T
        parts.append(axes.T @ turn)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def plan_code(count: int, min_cosine: float, recall: float) -> tuple[int, int]:
    """(s, m): bits of a substring and number of substrings.

    s follows the number of vectors, so that a bucket holds a few of them; m is what
    reaches ``recall`` for a pair right at ``min_cosine`` when each sign differs with
    the probability angle / pi.
    """
    s = min(28, max(8, round(math.log2(max(count, 2))) - 2))
    differ = math.acos(min_cosine) / math.pi
    hit = (1 - differ) ** s + s * differ * (1 - differ) ** (s - 1)
    return s, max(2, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _usable(df: DataFrame, id_col: str, group_col: str, vec_col: str, units: bool = True) -> DataFrame:
    """grp, id, digest and, if asked for, unit of every usable vector; grp holds the dimension."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch["vec"]
            starts, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(starts)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                wide = values[starts[rows][:, None] + np.arange(dim)].astype("f8")
                with np.errstate(over="ignore", invalid="ignore"):
                    length = np.sqrt((wide * wide).sum(axis=1))
                good = (length > 0) & (length < math.inf)
                rows, unit = rows[good], (wide[good] / length[good][:, None]).astype("f4")
                kept = batch.take(pa.array(rows))
                columns = {
                    "grp": pc.binary_join_element_wise(kept["grp"], str(dim), "/"),
                    "id": kept["id"],
                    "digest": pa.array([xxhash.xxh3_128_digest(u) for u in unit], pa.binary()),
                }
                if units:
                    columns["unit"] = pa.ListArray.from_arrays(
                        pa.array(np.arange(0, unit.size + 1, dim), pa.int32()), pa.array(unit.ravel())
                    )
                yield pa.RecordBatch.from_pydict(columns)

    named = df.select(
        F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("grp"),
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vec_col).alias("vec"),
    ).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    return named.mapInArrow(scan, "grp string, id bigint, digest binary" + ", unit array<float>" * units)


def _encode(reps: DataFrame, models: dict[str, tuple[int, np.ndarray, np.ndarray]], s: int, m: int) -> DataFrame:
    """g, rep, subs of every class representative."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = (1 << np.arange(s)).astype("i8")
        for batch in batches:
            for grp, part in batch.groupby("grp", sort=False):
                number, mean, turn = models[grp]
                bits = (np.stack(part["unit"].to_numpy()).astype("f8") - mean) @ turn >= 0
                subs = bits[:, : s * m].reshape(len(part), m, s) @ weights
                yield pd.DataFrame({"g": number, "rep": part["rep"].to_numpy(), "subs": list(subs)})

    return reps.select("grp", "rep", "unit").mapInPandas(scan, "g int, rep bigint, subs array<bigint>")


def _row_type(dim: int) -> np.dtype:
    """One vector in one substring's index: the substring, which bit was flipped for it to be here (-1: none), and what
    comparisons need."""
    return np.dtype(
        [("sub", "u4"), ("flip", "i1"), ("rep", "i8"), ("sketch", "u8"), ("scale", "f4"), ("error", "f4"), ("bytes", "i1", (dim,))]
    )


def _dim(grp: str) -> int:
    return int(grp.rpartition("/")[2])


def _plan_parts(sizes: dict[str, int], tables: list[int], s: int) -> tuple[dict[str, tuple[int, dict[int, int]]], int]:
    """Per group the leading bits of a substring that choose the part, and the first partition of every table; partitions."""
    out, used, room = {}, 0, 0
    for grp, count in sorted(sizes.items()):
        size = count * _row_type(_dim(grp)).itemsize
        cut = min(s, max(0, math.ceil(math.log2(size / PART_BYTES))))
        first = {}
        for t in tables:
            if size > PART_BYTES // 8:
                first[t], used, room = used, used + (1 << cut), 0
            else:  # small groups share a partition
                if room < size:
                    used, room = used + 1, PART_BYTES // 8
                first[t], room = used - 1, room - size
        out[grp] = cut, first
    return out, max(1, used)


def _spread(
    classes: DataFrame, models: dict[str, tuple[int, np.ndarray, np.ndarray]], sizes: dict[str, int], s: int, tables: list[int]
) -> DataFrame:
    """g, t, part, rows: the vectors as packed rows, in the partition of their substring's first bits.

    Vectors whose substrings differ in one of these bits meet where that bit is set: the
    one without it is sent there as well.
    """
    parts, count = _plan_parts(sizes, tables, s)
    schema = pa.schema([("pid", pa.int32()), ("g", pa.int32()), ("t", pa.int32()), ("part", pa.int32()), ("rows", pa.binary())])

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        groups = np.asarray(table["grp"].to_pylist(), dtype=object)
        weights = (1 << np.arange(s)).astype("i8")
        for grp in sorted(set(groups)):
            some = table.filter(pa.array(groups == grp))
            units = some["unit"].combine_chunks().flatten().to_numpy().reshape(len(some), -1)
            number, mean, turn = models[grp]
            cut, first = parts[grp]
            centred = units.astype("f8") - mean
            base = np.zeros(len(units), _row_type(units.shape[1]))
            base["rep"] = some["rep"].to_numpy()
            base["sketch"] = np.packbits(centred @ turn[:, :64] >= 0, axis=1).view(">u8").ravel()
            base["scale"] = np.abs(units).max(axis=1) / 127
            steps = base["scale"].astype("f8")[:, None]
            base["bytes"] = np.clip(np.rint(units / steps), -127, 127)
            base["error"] = np.sqrt(((units - base["bytes"] * steps) ** 2).sum(axis=1)) + 1e-6
            for t in tables:
                sub = (centred @ turn[:, t * s : (t + 1) * s] >= 0) @ weights
                which, subs, flips = [np.arange(len(sub))], [sub], [np.full(len(sub), -1)]
                for bit in range(s - cut, s):
                    without = np.flatnonzero(sub >> bit & 1 == 0)
                    which.append(without)
                    subs.append(sub[without] | 1 << bit)
                    flips.append(np.full(len(without), bit))
                subs = np.concatenate(subs)
                place = subs >> (s - cut)
                order = np.argsort(place, kind="stable")
                rows = base[np.concatenate(which)[order]]
                rows["sub"], rows["flip"] = subs[order], np.concatenate(flips)[order]
                found, starts = np.unique(place[order], return_index=True)
                ends = [*starts[1:], len(rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first[t] + found, pa.int32()),
                        pa.array(np.full(len(found), number), pa.int32()),
                        pa.array(np.full(len(found), t), pa.int32()),
                        pa.array(found, pa.int32()),
                        pa.array([rows[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    schema=schema,
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CODE_BYTES:
                yield from packed(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from packed(pa.Table.from_batches(held))

    rows = classes.select("grp", "rep", "unit").mapInArrow(scan, "pid int, g int, t int, part int, rows binary")
    return rows.repartitionById(count, F.col("pid")).select("g", "t", "part", "rows")


def _partners(first: np.ndarray, start: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every row ``first`` with each of the ``many`` rows from ``start`` on, in blocks."""
    wide = many > PAIRS_AT_ONCE
    for a, b, n in zip(first[wide], start[wide], many[wide]):
        for low in range(b, b + n, PAIRS_AT_ONCE):
            other = np.arange(low, min(low + PAIRS_AT_ONCE, b + n))
            yield np.full(len(other), a), other
    first, start, many = first[~wide], start[~wide], many[~wide]
    ends = np.cumsum(many)
    low = 0
    while low < len(many):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        n = many[low:high]
        before = np.cumsum(n) - n
        yield np.repeat(first[low:high], n), np.arange(n.sum()) + np.repeat(start[low:high] - before, n)
        low = high


def _runs(values: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array, where each begins (plus ``offset``), and how often it comes."""
    found, starts, counts = np.unique(values, return_index=True, return_counts=True)
    return found, starts + offset, counts


def _meetings(rows: np.ndarray, low_bits: int, hot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, sorted by flip and substring, whose substrings are equal or one bit apart, unless both are in hot buckets."""
    home = int(np.searchsorted(rows["flip"], 0))
    values, starts, counts = _runs(rows["sub"][:home], 0)
    own = np.repeat(np.where(counts > hot, 0, starts + counts), counts)
    here = np.arange(home)
    many = np.maximum(own - here - 1, 0)
    yield from _partners(here[many > 0], here[many > 0] + 1, many[many > 0])

    def across(found: np.ndarray, begin: np.ndarray, number: np.ndarray, wanted: np.ndarray):
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        good = (values[at] == wanted) & ((number <= hot) | (counts[at] <= hot))
        begin, number, at = begin[good], number[good], at[good]
        each = np.repeat(np.arange(len(begin)), number)
        row = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number)
        yield from _partners(row, starts[at][each], counts[at][each])

    if not home:
        return
    for bit in range(low_bits):
        lower = values >> np.uint32(bit) & np.uint32(1) == 0
        yield from across(values[lower], starts[lower], counts[lower], values[lower] | np.uint32(1 << bit))
    for bit in sorted(set(rows["flip"][home:].tolist())):
        a, b = np.searchsorted(rows["flip"], [bit, bit + 1])
        found, begin, number = _runs(rows["sub"][a:b], int(a))
        yield from across(found, begin, number, found)


def _candidates(
    spread: DataFrame, cuts: dict[int, tuple[int, int]], s: int, most_apart: int, min_cosine: float, hot: int
) -> DataFrame:
    """kind, g, a, b: pairs that may reach the cosine (kind 0), and table and substring of hot buckets (kind 1).

    ``cuts``: dimension and leading bits of every group. The bytes of a vector are off by at
    most its ``error``, so no pair that reaches ``min_cosine`` is dropped by them.
    """

    def near(rows: np.ndarray, low_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sketch, error = np.ascontiguousarray(rows["sketch"]), rows["error"].astype("f8")
        scale, levels = rows["scale"].astype("f8"), np.ascontiguousarray(rows["bytes"])
        block = max(1, CODE_BYTES // (4 * levels.shape[1]))
        for one, two in _meetings(rows, low_bits, hot):
            close = np.bitwise_count(sketch[one] ^ sketch[two]) <= most_apart
            one, two = one[close], two[close]
            for low in range(0, len(one), block):
                x, y = one[low : low + block], two[low : low + block]
                dots = np.einsum("ij,ij->i", levels[x].astype("f4"), levels[y].astype("f4")) * scale[x] * scale[y]
                good = dots + error[x] + error[y] + 3 * error[x] * error[y] >= min_cosine - 1e-5
                yield x[good], y[good]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[bytes]] = {}
        for batch in batches:
            for g, t, part, rows in zip(*(batch[c].to_pylist() for c in ("g", "t", "part", "rows"))):
                held.setdefault((g, t, part), []).append(rows)
        while held:
            (g, t, _), parts = held.popitem()
            dim, cut = cuts[g]
            rows = np.frombuffer(b"".join(parts), _row_type(dim))
            del parts
            rows = rows[np.lexsort((rows["sub"], rows["flip"]))]
            home = rows["sub"][: np.searchsorted(rows["flip"], 0)]
            values, _, counts = _runs(home, 0)
            crowded = values[counts > hot].astype("i8")
            yield made(1, g, np.full(len(crowded), t), crowded)
            for one, two in near(rows, s - cut):
                a, b = rows["rep"][one], rows["rep"][two]
                other = a != b
                yield made(0, g, np.minimum(a, b)[other], np.maximum(a, b)[other])

    def made(kind: int, g: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind), pa.int32()), pa.array(np.full(len(a), g), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
            names=["kind", "g", "a", "b"],
        )

    return spread.mapInArrow(scan, "kind int, g int, a bigint, b bigint")


def _hot_pairs(hot_probes: DataFrame, hot_index: DataFrame, units: DataFrame, k: int, floor: float) -> DataFrame:
    """g, a, b, cosine: per block of a hot bucket, the k best of every query."""

    def blocked(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HOT_BUCKET).cast("int").alias(f"n_{name}"))
        cut = rows.join(sizes, "key").withColumn(
            name, F.pmod(F.xxhash64("g", "rep"), F.col(f"n_{name}")).cast("int")
        )
        return cut.join(units, ["g", "rep"]).select("key", "g", "rep", "unit", name, f"n_{name}")

    left, right = blocked(hot_probes, "x"), blocked(hot_index, "y")
    sizes_x = left.select("key", "n_x").distinct()
    sizes_y = right.select("key", "n_y").distinct()
    left = left.join(sizes_y, "key").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n_y") - 1)))
    right = right.join(sizes_x, "key").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_x") - 1)))
    left = left.select("key", "x", "y", "g", "rep", "unit")
    right = right.select(*(F.col(c).alias(f"{c}_r") for c in ("key", "x", "y", "rep", "unit")))

    def best(queries: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(others):
            return pd.DataFrame({"g": [], "a": [], "b": [], "cosine": []})
        ids = others["rep_r"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        cosines = np.stack(queries["unit"].to_numpy()) @ np.stack(others["unit_r"].to_numpy())[order].T
        cosines[queries["rep"].to_numpy()[:, None] == ids[None, :]] = -2
        top = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(cosines, top, axis=1)
        row, col = np.nonzero(found >= floor - 1e-6)
        return pd.DataFrame(
            {
                "g": queries["g"].iloc[0],
                "a": queries["rep"].to_numpy()[row],
                "b": ids[top[row, col]],
                "cosine": found[row, col].astype("f8"),
            }
        )

    return left.groupBy("key", "x", "y").cogroup(right.groupBy("key_r", "x_r", "y_r")).applyInPandas(
        best, "g int, a bigint, b bigint, cosine double"
    )


def most_similar(
    df: DataFrame,
    id_col: str,
    group_col: str,
    vec_col: str,
    k: int = 5,
    min_cosine: float = 0.9,
    recall: float = 0.97,
    sketch_sigmas: float = 3.0,
) -> DataFrame:
    """grp, id, other, cosine, rank: the k most similar vectors of cosine ``min_cosine`` or more.

    ``recall``: what the indexes shall reach for pairs right at ``min_cosine``; more
    similar pairs are missed less. ``sketch_sigmas``: standard deviations above the
    expected number of differing sketch bits, at ``min_cosine``, up to which a pair is
    looked at.
    """
    if k < 1 or not 0 < min_cosine < 1 or not 0 < recall < 1:
        raise ValueError("k must be positive, min_cosine and recall between 0 and 1")
    spark = df.sparkSession
    scratch = Scratch(spark, "similar", free_shuffles=True)
    usable = _usable(df, id_col, group_col, vec_col)
    # The digest first: rows are sorted by it, and names of groups are mostly equal.
    classes = usable.groupBy("digest", "grp").agg(F.min(F.struct("id", "unit")).alias("one"))
    classes = scratch.keep(classes.select("grp", "digest", F.col("one.id").alias("rep"), "one.unit"), "classes")
    sizes = {row["grp"]: row["count"] for row in classes.groupBy("grp").count().collect()}
    count = max(sizes.values(), default=0)
    s, m = plan_code(count, min_cosine, recall)

    share = min(SAMPLE_ROWS, max(1, SAMPLE_TOTAL // max(1, len(sizes))))
    drawn = Window.partitionBy("grp").orderBy(F.xxhash64("rep"))
    sample = classes.select("grp", "rep", "unit", F.row_number().over(drawn).alias("n")).where(F.col("n") <= share)
    sample = scratch.keep(sample, "sample")
    learned = {}
    for number, (grp, part) in enumerate(sorted(sample.toPandas().groupby("grp"))):
        mean, turn = learn_rotations(np.stack(part["unit"].to_numpy()).astype("f8"), max(64, s * m), number)
        learned[grp] = (number, mean, turn)
    numbers = spark.createDataFrame(
        [(grp, number) for grp, (number, _, _) in learned.items()] or [("", -1)], "grp string, g int"
    )
    units = classes.join(F.broadcast(numbers), "grp").select("g", "rep", "unit")
    members = (
        _usable(df, id_col, group_col, vec_col, units=False)
        .distinct()
        .join(classes.select("grp", "digest", "rep"), ["digest", "grp"])
        .join(F.broadcast(numbers), "grp")
        .select("g", "rep", "id")
    )
    members = scratch.keep(members, "members")

    differ = math.acos(min_cosine) / math.pi
    most_apart = int(64 * differ + sketch_sigmas * math.sqrt(64 * differ * (1 - differ)))
    bytes_of_units = sum(4 * _dim(grp) * n for grp, n in sizes.items())
    pass_bytes = max(PASS_BYTES, PASS_SHARE * bytes_of_units)
    cuts = {grp: cut for grp, (cut, _) in _plan_parts(sizes, [0], s)[0].items()}
    a_table = sum(n * (1 + cuts[grp] / 2) * _row_type(_dim(grp)).itemsize for grp, n in sizes.items())
    at_once = max(1, int(pass_bytes // max(1, a_table)))
    by_number = {learned[grp][0]: (_dim(grp), cut) for grp, cut in cuts.items()}
    met = []
    for low in range(0, m, at_once):
        spread = _spread(classes, learned, sizes, s, list(range(low, min(m, low + at_once))))
        met.append(scratch.keep(_candidates(spread, by_number, s, most_apart, min_cosine, HOT_BUCKET), "met"))
    every = functools.reduce(DataFrame.unionByName, met)
    pairs = scratch.keep(every.where("kind = 0").select("g", "a", "b").distinct(), "pairs")
    crowded = scratch.keep(
        every.where("kind = 1").select("g", F.col("a").cast("int").alias("t"), F.col("b").alias("sub")), "crowded"
    )
    scratch.drop(*met)

    one = units.select("g", F.col("rep").alias("a"), F.col("unit").alias("unit_a"))
    two = units.select("g", F.col("rep").alias("b"), F.col("unit").alias("unit_b"))
    dot = F.aggregate(
        F.zip_with("unit_a", "unit_b", lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    bytes_of_pairs = pairs.count() * (24 + 4 * max((_dim(grp) for grp in sizes), default=0))
    passes = max(1, math.ceil(bytes_of_pairs / pass_bytes))
    ranked = []
    for n in range(passes):
        some = pairs.where(F.pmod(F.xxhash64("g", "a"), F.lit(passes)) == n) if passes > 1 else pairs
        scored = some.join(one, ["g", "a"]).join(two, ["g", "b"]).select("g", "a", "b", dot.alias("cosine"))
        ranked.append(scratch.keep(scored.where(F.col("cosine") >= min_cosine), "ranked"))
    scored = functools.reduce(DataFrame.unionByName, ranked)
    both = scored.unionByName(scored.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))

    found = crowded.take(HOT_BROADCAST + 1)
    hot_pairs = None
    if found:
        codes = scratch.keep(_encode(classes, learned, s, m), "codes")
        subs = codes.select("g", "rep", F.posexplode("subs").alias("t", "sub"))
        few = len(found) * (s + 1) <= HOT_BROADCAST
        hot = (spark.createDataFrame(found, crowded.schema) if few else crowded).withColumn("key", F.xxhash64("g", "t", "sub"))
        masks = F.explode(F.array(*(F.lit(0 if n < 0 else 1 << n).cast("bigint") for n in range(-1, s))))
        around = hot.withColumn("mask", masks).withColumn("sub", F.col("sub").bitwiseXOR(F.col("mask"))).drop("mask")
        ways = [F.broadcast(x) if few else x for x in (around, hot)]
        probes, index = (subs.join(x, ["g", "t", "sub"]).select("key", "g", "rep") for x in ways)
        hot_pairs = scratch.keep(_hot_pairs(probes, index, units, k, min_cosine), "hot")
        both = both.unionByName(hot_pairs).groupBy("g", "a", "b").agg(F.max("cosine").alias("cosine"))
    nearest = Window.partitionBy("g", "a").orderBy(F.desc("cosine"), "b")
    near = both.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k)
    near = scratch.keep(near.select("g", "a", "b", "cosine"), "near")
    scratch.drop(sample, classes, pairs, crowded, hot_pairs, *ranked)

    members = members.join(F.broadcast(numbers), "g").select("g", "grp", "rep", "id")
    plural = members.groupBy("g", "rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    itself = plural.select("g", F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine"))
    first = Window.partitionBy("g", "rep").orderBy("id")
    few = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    few = few.select("g", F.col("rep").alias("b"), F.col("id").alias("other"))
    queries = members.select("g", "grp", F.col("rep").alias("a"), "id")
    offered = (
        near.unionByName(itself).join(few, ["g", "b"]).select("g", "a", "other", "cosine").join(queries, ["g", "a"])
    ).where(F.col("id") != F.col("other"))
    best = Window.partitionBy("grp", "id").orderBy(F.desc("cosine"), "other")
    return (
        offered.select("grp", "id", "other", "cosine", F.row_number().over(best).alias("rank"))
        .where(F.col("rank") <= k)
    )


def similar_pairs(df: DataFrame, id_col: str, group_col: str, vec_col: str, **options) -> DataFrame:
    """asset_a < asset_b: pairs of which one is among the most similar of the other."""
    found = most_similar(df, id_col, group_col, vec_col, **options).where(F.col("id") != F.col("other"))
    return found.select(
        F.least("id", "other").alias("asset_a"), F.greatest("id", "other").alias("asset_b")
    ).distinct()

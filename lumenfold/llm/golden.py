"""Best representative of each duplicate group, by skyline selection.

Each record of a group is a point of several policy dimensions. Records that no
other beats in every dimension form the first dominance layer, those left after
taking it away the second, and so on. The lexicographic policy picks the survivor
from the first layer, and each field that the survivor lacks comes from the first
record, in order of layer and policy, that has it.

Groups are read in policy order, in which dominators come first, so one pass gives
the layers. A group of more than HOT_GROUP records is cut into chunks whose own
first layers are found side by side; only those meet in one task. It is peeled on,
twice as many layers each time, while a wanted field that a record left has is still
null in the layers taken, so the layer used is always the true one.

Defined results: null dimensions rank lowest; equal records share a layer and rank
by smaller id; a group without a record has no survivor (null); repeated rows count
once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Layers told apart by ``dominance_layers`` unless more are asked for, and layers of the first peeling.
MOST_LAYERS = 4
#: Records of a group beyond which it is layered in chunks.
HOT_GROUP = 5_000
HOT_GROUPS_BROADCAST = 100_000

#: Trust of sources and of date sources, and the formats that keep the capture whole.
SOURCE_TRUST = ("originals", "icloud", "google")
DATE_TRUST = ("exif", "json", "filename", "mtime")
RAW_FORMATS = ("raw", "heic", "heif", "dng", "arw", "cr2", "cr3", "nef", "orf", "raf", "rw2")


def _beats(one: tuple, other: tuple) -> bool:
    """True if ``one`` is at least as good in every dimension and better in one."""
    return one != other and all(x >= y for x, y in zip(one, other))


def layers_in_order(points: list[tuple], most: int | None = None) -> list[int]:
    """Layer (from 1) of each point of a list that is sorted best first; all from ``most`` on are one layer."""
    fronts: list[list[tuple]] = []
    out = []
    previous: tuple | None = None
    for point in points:
        if point == previous:
            out.append(out[-1])
            continue
        previous = point
        # What a layer beats, every layer before it beats too.
        layer, beyond = 0, len(fronts)
        while layer < beyond:
            middle = (layer + beyond) // 2
            if any(_beats(front, point) for front in reversed(fronts[middle])):
                layer = middle + 1
            else:
                beyond = middle
        if layer == len(fronts) and (most is None or layer < most - 1):
            fronts.append([])
        if layer < len(fronts):
            fronts[layer].append(point)
        out.append(layer + 1)
    return out


def _layered(rows: DataFrame, by: list[str], most: int | None) -> DataFrame:
    """grp, id, layer, place: layers within each ``by``; place counts in policy order."""
    kind = dict(rows.dtypes)["grp"]
    order = [*by, F.desc("dims"), F.asc("id")]
    placed = rows.select(*by, "id", "dims").repartition(*by).sortWithinPartitions(*order)
    width = len(by)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, points = None, [], []
        done_group, done_id, done_layer, done_place = [], [], [], []

        def close() -> None:
            done_group.extend([current[0]] * len(ids))
            done_id.extend(ids)
            done_layer.extend(layers_in_order(points, most))
            done_place.extend(range(len(ids)))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(done_group, pa.int64() if kind == "bigint" else pa.string()),
                    pa.array(done_id, pa.int64()),
                    pa.array(done_layer, pa.int32()),
                    pa.array(done_place, pa.int64()),
                ],
                names=["grp", "id", "layer", "place"],
            )
            for done in (done_group, done_id, done_layer, done_place):
                done.clear()
            return out

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in range(width + 2)]
            for row in zip(*columns):
                key = row[:width]
                if key != current:
                    if current is not None:
                        close()
                    current, ids, points = key, [], []
                ids.append(row[width])
                points.append(tuple(row[width + 1]))
            yield flush()
        if current is not None:
            close()
            yield flush()

    return placed.mapInArrow(scan, f"grp {kind}, id bigint, layer int, place bigint")


def dominance_layers(
    rows: DataFrame, most: int | None = MOST_LAYERS, hot_group: int = HOT_GROUP, wanted: tuple[str, ...] = ()
) -> DataFrame:
    """grp, id, layer, place of rows (grp, id, dims ARRAY<BIGINT>, larger is better).

    All from layer ``most`` on are one layer. If it is None, groups have all their
    layers, and hot groups all up to where no column of ``wanted`` that is null in the
    layers so far has a value in the rest; that rest is one layer.
    """
    flags = [f"has_{n}" for n in range(len(wanted))]
    has = [F.max(F.col(w).isNotNull()).alias(f) for w, f in zip(wanted, flags)]
    rows = rows.groupBy("grp", "id", "dims").agg(*has) if has else rows.select("grp", "id", "dims").distinct()
    sizes = rows.groupBy("grp").count().where(F.col("count") > hot_group)
    hot = sizes.select("grp", F.ceil(F.col("count") / hot_group).cast("int").alias("chunks"))
    found = hot.take(HOT_GROUPS_BROADCAST + 1)
    if not found:
        return _layered(rows, ["grp"], most)
    scratch = Scratch(rows.sparkSession, "layers")
    if len(found) <= HOT_GROUPS_BROADCAST:
        hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    plain = _layered(rows.join(hot, "grp", "left_anti"), ["grp"], most)
    rest = rows.join(hot, "grp").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rest = scratch.keep(rest, "hot")
    out = []
    taken, step = 0, MOST_LAYERS
    filled = None
    while most is None or taken < most - 1:
        # A record of the group's first layers is in the first layers of its chunk, and so are all that beat it.
        step = step if most is None else min(step, most - 1 - taken)
        chunk_best = _layered(rest, ["grp", "chunk"], step + 1).where(F.col("layer") <= step).select("grp", "id")
        met = rest.join(chunk_best, ["grp", "id"], "left_semi")
        layers = _layered(met, ["grp"], step + 1).where(F.col("layer") <= step).select("grp", "id", "layer")
        front = scratch.keep(rest.join(layers.distinct(), ["grp", "id"]), "front")
        out.append(front.select("grp", "id", (F.col("layer") + taken).alias("layer")))
        rest = scratch.keep(rest.join(front, ["grp", "id"], "left_anti"), "hot")
        taken, step = taken + step, 2 * step
        if most is not None:
            continue
        if not flags:
            break
        has = front.groupBy("grp").agg(*(F.max(f).alias(f) for f in flags))
        if filled is not None:
            has = filled.unionByName(has).groupBy("grp").agg(*(F.max(f).alias(f) for f in flags))
        filled = scratch.keep(has, "filled")
        lacking = filled.select("grp", *(F.col(f).alias(f"old_{f}") for f in flags))
        helps = " or ".join(f"({f} and not old_{f})" for f in flags)
        open_groups = scratch.keep(rest.join(lacking, "grp").where(helps).select("grp").distinct(), "open")
        closed = rest.join(open_groups, "grp", "left_anti")
        out.append(closed.select("grp", "id", F.lit(taken + 1).alias("layer")))
        rest = scratch.keep(rest.join(open_groups, "grp", "left_semi"), "hot")
        if rest.isEmpty():
            break
    out.append(rest.select("grp", "id", F.lit(taken + 1).alias("layer")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    # The order within a layer is the policy's; no window runs over a hot group.
    place = F.lit(0).cast("bigint")
    return plain.unionByName(whole.select("grp", "id", "layer", place.alias("place")))


def rank_of(value: Column, best_first: tuple[str, ...]) -> Column:
    """Trust of a word: the first of the list highest, others 0."""
    out = F.lit(0)
    folded = F.lower(F.trim(value))
    for n, word in enumerate(best_first):
        out = F.when(folded == word, len(best_first) - n).otherwise(out)
    return out.cast("bigint")


def policy_dims(records: DataFrame) -> Column:
    """Completeness, pixels, bytes, format, trust of source and recency, as ARRAY<BIGINT>, in order of policy.

    Recency is the file's time of change, where the records have one. It comes last, so
    it decides the survivor only between records that are alike in all else, but a more
    recent record is in a better layer when fields are filled.
    """
    recency = F.coalesce(F.floor("mtime").cast("bigint"), F.lit(-1)) if "mtime" in records.columns else F.lit(-1).cast("bigint")
    pixels = F.col("width").cast("bigint") * F.col("height").cast("bigint")
    return F.array(
        F.coalesce(F.col("exif_fields").cast("bigint"), F.lit(0)),
        F.coalesce(pixels, F.lit(-1)),
        F.coalesce(F.col("bytes"), F.lit(-1)),
        F.lower("format").isin(*RAW_FORMATS).cast("bigint"),
        rank_of(F.col("source"), SOURCE_TRUST),
        recency,
    )


def golden_records(
    clusters: DataFrame,
    membership: DataFrame,
    records: DataFrame,
    fields: tuple[str, ...] = (),
    hot_group: int = HOT_GROUP,
) -> DataFrame:
    """cluster_id, keep_asset_id, date_asset_id, and each of ``fields`` filled by layer.

    keep: the survivor of the policy. date: the member with a capture date from the
    most trusted date source; among several the survivor, else the smallest id.
    """
    known = records.select(
        F.col("id").alias("asset_id"),
        policy_dims(records).alias("dims"),
        F.when(F.col("taken_at").isNotNull(), rank_of(F.col("taken_src"), DATE_TRUST)).alias("date_rank"),
        *(F.col(f).alias(f"field_{f}") for f in fields),
    )
    linked = membership.select("cluster_id", "asset_id").where(F.col("cluster_id").isNotNull()).distinct()
    members = linked.join(known, "asset_id").select(F.col("cluster_id").alias("grp"), F.col("asset_id").alias("id"), "*")
    scratch = Scratch(records.sparkSession, "golden")
    members = scratch.keep(members.drop("asset_id", "cluster_id").distinct(), "members")
    # Without fields only the first layer counts.
    most, wanted = (None, tuple(f"field_{f}" for f in fields)) if fields else (2, ())
    ranked = members.join(dominance_layers(members, most, hot_group, wanted), ["grp", "id"])
    negative = F.transform("dims", lambda x: -x)
    order = F.struct("layer", negative, "id")
    kept = ranked.groupBy("grp").agg(
        F.min_by("id", order).alias("keep_asset_id"),
        *(
            F.min_by(f"field_{f}", F.when(F.col(f"field_{f}").isNotNull(), order)).alias(f)
            for f in fields
        ),
        F.max("date_rank").alias("best_date"),
        F.min(F.when(F.col("date_rank") == 4, F.col("id"))).alias("d4"),
        F.min(F.when(F.col("date_rank") == 3, F.col("id"))).alias("d3"),
        F.min(F.when(F.col("date_rank") == 2, F.col("id"))).alias("d2"),
        F.min(F.when(F.col("date_rank") == 1, F.col("id"))).alias("d1"),
        F.min(F.when(F.col("date_rank") == 0, F.col("id"))).alias("d0"),
        F.min_by("date_rank", order).alias("keep_date"),
    )
    smallest = F.coalesce("d4", "d3", "d2", "d1", "d0")
    dated = kept.withColumn(
        "date_asset_id", F.when(F.col("keep_date") == F.col("best_date"), F.col("keep_asset_id")).otherwise(smallest)
    )
    every = clusters.select(F.col("id").alias("cluster_id")).where(F.col("cluster_id").isNotNull()).distinct()
    return every.join(dated.withColumnRenamed("grp", "cluster_id"), "cluster_id", "left").select(
        "cluster_id", "keep_asset_id", "date_asset_id", *fields
    )

"""Deduplicating new batches against all history, with persisted minwise band keys.

Every accepted record leaves key rows in a store: one key of its normalised path, and
one per minwise band of its fingerprint together with the time slot of its capture,
each with the fingerprint and second that verify a match. A batch probes only the
parts of the store that its keys fall in, matches are verified exactly, and the keys
of accepted arrivals are appended.

Minwise bands: a fingerprint is the set of its 64 (place, bit) elements, of which two
fingerprints that differ in d bits share 64 - d of 64 + d. A minwise hash is the
element that comes first in a fixed order of all 128; two fingerprints agree in it
with that share (58/70 at 6 bits). A band joins ROWS hashes, and there are BANDS of
them: a pair at 6 bits is missed with probability (1 - (58/70)^2)^8, about 1 in
10 000, at 4 bits 1 in 170 000. Chance hits stay few since the slot is in the key.

The store is a folder of segments, one per batch. A segment is written beside the
store and put in place by one rename, so readers see all of it or nothing, and writing
a batch again replaces its segment. Its parts are by hash, their number grows with
its rows, and each is sorted by key. A batch is compared with the segments before its
own, so running it again gives the same rows. ``compact`` joins segments into one.

Arrivals among themselves are decided in order. Equal signatures (fingerprint and
second) and equal paths are classes, of which at most one arrival is accepted;
classes are linked where signatures are near, and each connected part is decided
by one pass in order, side by side with the others.

Defined results: null or blank paths, null fingerprints and unreadable dates match
nothing; repeated rows count once; arrivals with equal batch and id are one.
"""

from __future__ import annotations

import hashlib
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import blocked_join
from ..operators.timestamps import parsed
from ..session import Scratch
from .components import connected_components

MOST_BITS = 6
MOST_SECONDS = 2
#: Seconds of a time slot; a probe looks into the one or two slots it can reach.
SLOT = 8
#: Minwise bands of a fingerprint, and hashes of a band.
BANDS, ROWS = 8, 2
#: Key rows of one part of a segment, and most parts of a segment.
PART_ROWS, MOST_PARTS = 250_000, 1 << 18
#: Name of the segment of the ledger; batches come after it.
LEDGER = "0-ledger"


def _fold(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: unicodedata.normalize("NFC", unicodedata.normalize("NFC", p).casefold()), na_action="ignore")


def path_key(path: Column) -> Column:
    """The path with letter case, Unicode form and redundant separators made even.

    Plain ASCII paths stay in the JVM; only others go to Python.
    """
    ascii_only = path.rlike(r"^[\x00-\x7F]*$")
    fold = F.pandas_udf(_fold, "string")
    folded = F.when(ascii_only, F.lower(path)).otherwise(fold(F.when(~ascii_only, path)))
    tidy = F.regexp_replace(F.regexp_replace(folded, r"(/\.)+(?=/|$)", ""), r"/+", "/")
    tidy = F.regexp_replace(F.regexp_replace(tidy, r"^\./", ""), r"(?<=.)/$", "")
    return F.when(F.trim(tidy) != "", tidy)


def _signed(df: DataFrame) -> DataFrame:
    """id, path_id, phash, sec of records (id, path, phash, taken_at), and any order columns."""
    rest = [c for c in df.columns if c not in ("path", "taken_at")]
    return df.select(
        *rest,
        F.xxhash64(path_key(F.col("path"))).alias("path_hash"),
        path_key(F.col("path")).isNotNull().alias("has_path"),
        parsed(F.col("taken_at"), wall_only=True)["secs"].alias("sec"),
    ).select(*rest, F.when(F.col("has_path"), F.col("path_hash")).alias("path_id"), "sec")


@lru_cache(maxsize=1)
def minwise_tables() -> np.ndarray:
    """For each hash, each byte of a fingerprint and each value of it, the first rank of its elements.

    The order of the 128 elements is that of a digest, so that a store stays readable.
    """
    tables = np.zeros((BANDS * ROWS, 8, 256), "u1")
    for n in range(BANDS * ROWS):
        order = sorted(range(128), key=lambda e: hashlib.blake2b(f"{n}:{e}".encode(), digest_size=8).digest())
        rank = np.zeros(128, "u1")
        rank[order] = np.arange(128)
        for byte in range(8):
            for value in range(256):
                tables[n, byte, value] = min(rank[2 * (8 * byte + bit) + (value >> bit & 1)] for bit in range(8))
    return tables


def minwise(phash: np.ndarray) -> np.ndarray:
    """The minwise hashes of fingerprints, one row each."""
    tables, halves = minwise_tables(), np.ascontiguousarray(phash, "<i8").view("u1").reshape(-1, 8)
    out = np.full((len(halves), BANDS * ROWS), 127, "u1")
    for n in range(BANDS * ROWS):
        for byte in range(8):
            np.minimum(out[:, n], tables[n, byte, halves[:, byte]], out=out[:, n])
    return out


def _packed(phash: pd.Series) -> pd.DataFrame:
    known = phash.notna().to_numpy()
    rows = minwise(phash[known].to_numpy("i8")).astype("i8")
    bands = rows[:, 0::ROWS].copy()
    for n in range(1, ROWS):
        bands = bands << 7 | rows[:, n::ROWS]
    half = BANDS // 2
    out = np.zeros((2, len(phash)), "i8")
    for side in (0, 1):
        packed = np.zeros(len(bands), "i8")
        for n in range(half):
            packed |= bands[:, side * half + n] << (7 * ROWS * n)
        out[side, known] = packed
    return pd.DataFrame({"low": out[0], "high": out[1]})


def with_signature(df: DataFrame) -> DataFrame:
    """Adds low and high, the minwise bands of phash; 0 where it is null."""
    packed = F.pandas_udf(_packed, "low bigint, high bigint")
    return df.withColumn("bands", packed("phash")).select(*df.columns, "bands.low", "bands.high")


def _bands(slot: Column) -> Column:
    """Keys of the minwise bands of a signature in a time slot."""
    half, keys = BANDS // 2, []
    for n in range(BANDS):
        packed = F.col("low") if n < half else F.col("high")
        band = F.shiftrightunsigned(packed, 7 * ROWS * (n % half)).bitwiseAND(F.lit((1 << 7 * ROWS) - 1))
        keys.append(F.xxhash64(F.lit(n), band, slot))
    return F.array(*keys)


def store_keys(signed: DataFrame) -> DataFrame:
    """key, id, path_id, phash, sec: what an accepted record leaves in the store.

    Rows of bands hold the fingerprint and the second, rows of paths the path.
    """
    nothing = F.array().cast("array<bigint>")
    whole = F.col("phash").isNotNull() & F.col("sec").isNotNull()
    bands = F.when(whole, _bands(F.floor(F.col("sec") / SLOT))).otherwise(nothing)
    by_print = signed.select(F.explode(bands).alias("key"), "id", F.lit(None).cast("bigint").alias("path_id"), "phash", "sec")
    by_path = signed.where(F.col("path_id").isNotNull()).select(
        F.xxhash64(F.lit("path"), "path_id").alias("key"),
        "id",
        "path_id",
        F.lit(None).cast("bigint").alias("phash"),
        F.lit(None).cast("bigint").alias("sec"),
    )
    return by_print.unionByName(by_path)


def probe_keys(signed: DataFrame) -> DataFrame:
    """key, new_id, new_path, new_phash, new_sec: what an arrival asks the store for."""
    whole = F.col("phash").isNotNull() & F.col("sec").isNotNull()
    slots = F.array_distinct(
        F.array(F.floor((F.col("sec") - MOST_SECONDS) / SLOT), F.floor((F.col("sec") + MOST_SECONDS) / SLOT))
    )
    bands = F.when(whole, F.flatten(F.transform(slots, _bands))).otherwise(F.array().cast("array<bigint>"))
    paths = F.when(F.col("path_id").isNotNull(), F.array(F.xxhash64(F.lit("path"), "path_id"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return signed.select(
        F.explode(F.concat(bands, paths)).alias("key"),
        F.col("id").alias("new_id"),
        F.col("path_id").alias("new_path"),
        F.col("phash").alias("new_phash"),
        F.col("sec").alias("new_sec"),
    )


def _near() -> Column:
    return (F.bit_count(F.col("phash").bitwiseXOR(F.col("new_phash"))) <= MOST_BITS) & (
        F.abs(F.col("sec") - F.col("new_sec")) <= MOST_SECONDS
    )


class HistoryStore:
    """The key rows of all accepted records, in segments by batch."""

    schema = "key bigint, id bigint, path_id bigint, phash bigint, sec bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def segments(self, before: str | None = None) -> dict[str, int]:
        """Names of the segments, in order, with the number of their parts."""
        files, root = self._files(self.path)
        if not files.exists(root):
            return {}
        names = (status.getPath().getName() for status in files.listStatus(root))
        found = dict(sorted(name.rsplit("~", 1) for name in names if "~" in name))
        return {name: int(parts) for name, parts in found.items() if before is None or name < before}

    def append(self, signed: DataFrame, segment: str) -> None:
        """Writes the keys of accepted records as a segment; one of that name is replaced."""
        self._place(store_keys(signed), signed.count() * (BANDS + 1), segment)

    def _place(self, rows: DataFrame, size: int, segment: str, replaced: list[str] | None = None) -> None:
        parts = 1
        while parts * PART_ROWS < size and parts < MOST_PARTS:
            parts *= 2
        beside = f"{self.path}-{uuid.uuid4().hex[:12]}"
        part = F.col("key").bitwiseAND(F.lit(parts - 1)).cast("int")
        # More partitions than parts, so that hardly two parts meet in one.
        spread = max(parts, min(4 * parts, 4_096))
        placed = rows.withColumn("part", part).repartition(spread, "part").sortWithinPartitions("part", "key")
        placed.write.partitionBy("part").option("compression", "zstd").parquet(beside)
        old = {name: count for name, count in self.segments().items() if name in {segment, *(replaced or ())}}
        files, root = self._files(self.path)
        files.mkdirs(root)
        for name, count in old.items():
            files.delete(self._files(f"{self.path}/{name}~{count}")[1], True)
        if not files.rename(self._files(beside)[1], self._files(f"{self.path}/{segment}~{parts}")[1]):
            raise OSError(f"could not put {segment} in place")

    def read(self, before: str | None = None, asked: DataFrame | None = None) -> DataFrame:
        """Rows of the segments before a name; only of the parts that asked keys fall in, if given."""
        segments = self.segments(before)
        wanted: set[int] | None = None
        most = max(segments.values(), default=1)
        if asked is not None and most > 1:
            # At most as many numbers as the largest segment has parts.
            found = asked.select(F.col("key").bitwiseAND(F.lit(most - 1)).alias("part")).distinct().collect()
            wanted = {row["part"] for row in found}
        out = self.spark.createDataFrame([], self.schema)
        for name, parts in segments.items():
            base = f"{self.path}/{name}~{parts}"
            chosen = [base]
            if wanted is not None:
                inside = {w & (parts - 1) for w in wanted}
                if len(inside) < parts:
                    files, _ = self._files(base)
                    paths = [f"{base}/part={n}" for n in sorted(inside)]
                    chosen = [p for p in paths if files.exists(self._files(p)[1])]
            if chosen:
                out = out.unionByName(self.spark.read.schema(self.schema).option("basePath", base).parquet(*chosen).select(*out.columns))
        return out

    def probe(self, signed: DataFrame, before: str | None = None) -> DataFrame:
        """known_id, new_id: every stored record that an arrival duplicates."""
        asked = probe_keys(signed)
        met = blocked_join(asked, self.read(before, asked), ["key"])
        same_path = F.col("path_id") == F.col("new_path")
        return met.where(same_path | _near()).select(F.col("id").alias("known_id"), "new_id").distinct()

    def compact(self, upto: str) -> None:
        """Joins all segments before a name into the first of them."""
        names = list(self.segments(upto))
        if len(names) > 1:
            rows = self.read(upto)
            self._place(rows, rows.count(), names[0], names)


def _decide(rows: DataFrame) -> DataFrame:
    """known_id, new_id among arrivals; known_id null: accepted.

    ``rows``: part, batch_no, id, path_id, sig, near (signature classes within
    reach), old (already known to duplicate history, so never accepted), in any order;
    each part is read once in order of batch_no and id.
    """
    placed = rows.repartition("part").sortWithinPartitions("part", "batch_no", "id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, by_path, by_sig = object(), {}, {}
        for batch in batches:
            known, new = [], []
            for part, _, number, path, sig, near, old in zip(*(batch.column(n).to_pylist() for n in range(7))):
                if part != current:
                    current, by_path, by_sig = part, {}, {}
                met = {by_path[path]} if path is not None and path in by_path else set()
                met.update(by_sig[s] for s in near or () if s in by_sig)
                if sig is not None and sig in by_sig:
                    met.add(by_sig[sig])
                if met:
                    known.extend(sorted(met))
                    new.extend([number] * len(met))
                if met or old:
                    continue
                known.append(None)
                new.append(number)
                if path is not None:
                    by_path[path] = number
                if sig is not None:
                    by_sig[sig] = number
            yield pa.RecordBatch.from_arrays(
                [pa.array(known, pa.int64()), pa.array(new, pa.int64())], names=["known_id", "new_id"]
            )

    ordered = placed.select("part", "batch_no", "id", "path_id", "sig", "near", "old")
    return ordered.mapInArrow(scan, "known_id bigint, new_id bigint")


def dedup_arrivals(store: HistoryStore, arrivals: DataFrame, append: bool = True) -> DataFrame:
    """known_id, new_id: every accepted record, old or new, that an arrival duplicates.

    ``arrivals``: id, batch_no, path, phash, taken_at, of one batch or several; they
    are decided in order of batch_no and id, against the segments of the store before
    their last batch. The keys of accepted arrivals become the segment of that batch
    if ``append``; run again, they replace it.
    """
    scratch = Scratch(arrivals.sparkSession, "arrivals")
    chosen = arrivals.select("id", "batch_no", "path", "phash", "taken_at").where(F.col("id").isNotNull())
    signed = scratch.keep(with_signature(_signed(chosen.dropDuplicates(["batch_no", "id"]))), "signed")
    last = signed.agg(F.max("batch_no")).first()[0]
    segment = f"1-{int(last or 0):012d}"
    old = scratch.keep(store.probe(signed, segment), "old")
    # Arrivals that duplicate history are never accepted, but may duplicate accepted arrivals too.
    rejected = old.select(F.col("new_id").alias("id")).distinct().withColumn("old", F.lit(True))
    sig = F.when(F.col("phash").isNotNull() & F.col("sec").isNotNull(), F.xxhash64("phash", "sec"))
    fresh = signed.join(rejected, "id", "left").withColumn("old", F.coalesce("old", F.lit(False))).withColumn("sig", sig)
    fresh = scratch.keep(fresh, "fresh")

    classes = fresh.where(F.col("sig").isNotNull()).groupBy("sig").agg(
        *(F.first(c).alias(c) for c in ("phash", "sec", "low", "high"))
    )
    nothing = F.lit(None).cast("bigint")
    as_rows = classes.select(F.col("sig").alias("id"), nothing.alias("path_id"), "phash", "sec", "low", "high")
    met = blocked_join(probe_keys(as_rows), store_keys(as_rows).drop("path_id"), ["key"])
    links = met.where((F.col("id") != F.col("new_id")) & _near()).select(
        F.col("new_id").alias("sig"), F.col("id").alias("other")
    )
    links = scratch.keep(links.distinct(), "links")

    # Nodes of the conflict graph: signature classes, and path classes with a bit flipped.
    path_node = F.xxhash64(F.lit("node"), "path_id")
    ties = fresh.where(F.col("sig").isNotNull() & F.col("path_id").isNotNull()).select(
        F.col("sig").alias("a"), path_node.alias("b")
    )
    parts = connected_components(links.select(F.col("sig").alias("a"), F.col("other").alias("b")).unionByName(ties))
    near = links.groupBy("sig").agg(F.collect_set("other").alias("near"))
    node = F.coalesce("sig", path_node, F.xxhash64(F.lit("alone"), "id"))
    rows = (
        fresh.withColumn("node", node)
        .join(parts, "node", "left")
        .join(near, "sig", "left")
        .select(F.coalesce("component", "node").alias("part"), "batch_no", "id", "path_id", "sig", "near", "old")
    )
    decided = scratch.keep(_decide(rows), "decided")
    if append:
        accepted = decided.where(F.col("known_id").isNull()).select(F.col("new_id").alias("id"))
        store.append(signed.join(accepted, "id", "left_semi"), segment)
    return old.unionByName(decided.where(F.col("known_id").isNotNull()))


def record_ledger(store: HistoryStore, ledger: DataFrame) -> None:
    """Writes the accepted records of a ledger as the first segment of the store."""
    accepted = ledger.where(F.col("status").isin("canonical", "promoted") & F.col("id").isNotNull())
    signed = with_signature(_signed(accepted.select("id", "path", "phash", "taken_at").distinct()))
    store.append(Scratch(ledger.sparkSession, "ledger").keep(signed, "signed"), LEDGER)


def dedup_inbox(ledger: DataFrame, inbox: DataFrame, store: HistoryStore | None = None) -> DataFrame:
    """known_id, new_id: the duplicates of an inbox against ledger and earlier arrivals.

    With a ``store`` that holds the ledger already, the ledger is not read again.
    """
    if store is None:
        store = HistoryStore(ledger.sparkSession, Scratch(ledger.sparkSession, "history").path("store"))
    if LEDGER not in store.segments():
        record_ledger(store, ledger)
    return dedup_arrivals(store, inbox, append=True)

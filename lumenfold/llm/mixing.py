"""Mixing sources to target weights, by soft membership and projected least squares.

A classifier (softmax regression over the tokens of a text and its shape) is fitted on
a bounded sample of labelled documents and predicts to which domain each text belongs;
domains are the sources with a target, and one for all other sources. Its posterior
alone spreads the tokens of a document over the domains; the label takes no part in
it. Nonnegative rates, at most the allowed repeats of the document's source, are
fitted by least squares, so that both the expected tokens of each domain and the
tokens by label meet the targets: a document's rate is a start by its label, moved by
one multiplier per domain and per label, and projected into its range. Every pass
gathers objective, residual and curvature of a few step lengths and keeps the best
(a projected Newton step, in the multipliers). Nothing but these sums, whose number
does not grow with the data, reaches the driver.

Rates become whole copies by systematic sampling along sizes and document hashes,
so the mix is reproducible and close to the rates.
The size of the mix is the largest for which no source with documents has to exceed
its repeats, by label or by expected tokens, unless it is given.

Defined results: null and empty texts have no tokens and no copies; documents of a
source without a target are not in the mix; a target without documents is reported
with a share of 0 and its share goes to the others in proportion; spelling of sources
(case, blanks, hyphens) does not count.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Labelled documents on which the classifier is fitted: about so many per domain, and in all.
SAMPLE_PER_DOMAIN = 1_000
SAMPLE_TOTAL = 20_000
#: Distinct tokens of a sampled document that are used, the most frequent of the whole text.
SAMPLE_TOKENS = 4_096
#: Sources without a target are one domain.
OTHER = "(other)"
#: Places of the features: token ids come first, then the shape of a text.
TOKEN_PLACES = 1 << 16
PLACES = TOKEN_PLACES + 256
#: Documents of one cell of the sampling of whole copies.
CELL = 100_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern that goes with the byte-level vocabularies.
TOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level tokenizer of a vocabulary file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        os.path.basename(path), pat_str=TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def source_key(source: Column) -> Column:
    """The source with case, outer blanks, and blanks or hyphens for underscores made even."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def features(code, text: str) -> tuple[np.ndarray, int]:
    """Distinct tokens and shape of a text, and the number of its tokens."""
    ids = code.encode_to_numpy(text, disallowed_special=())
    count = len(ids)
    shape = (
        min(79, int(3 * np.log2(count + 1))),
        80 + min(79, int(3 * np.log2(text.count("\n") + 1))),
        160 + min(79, 3 * count // max(1, len(text.encode("utf-8", "replace")) // 4)),
    )
    return np.concatenate([np.unique(ids).astype("i8"), TOKEN_PLACES + np.array(shape, "i8")]), count


class DomainModel:
    """Softmax regression over the features of a text, calibrated on held-out documents.

    The sample holds about as many documents of each domain, so scores are moved by the
    domains' true shares of all documents.
    """

    def __init__(self, samples: list[np.ndarray], labels: list[str], documents: dict[str, int], rounds: int = 10):
        self.domains = sorted(set(labels))
        place = {d: n for n, d in enumerate(self.domains)}
        self.temperature, self.accuracy = 1.0, float("nan")
        self.weights = np.zeros((PLACES, len(self.domains)), "f4")
        self.prior = np.zeros(len(self.domains))
        if not self.domains:
            return
        truth = np.array([place[label] for label in labels])
        drawn = np.bincount(truth, minlength=len(self.domains))
        self.prior = np.log(np.array([max(1, documents.get(d, 1)) for d in self.domains]) / drawn)
        fit, held = np.arange(0, len(truth), 2), np.arange(1, len(truth), 2)
        if len(held):
            self._fit(samples, truth, fit, rounds)
            raw = np.stack([self._scores(samples[n]) for n in held])
            self.accuracy = float((raw.argmax(axis=1) == truth[held]).mean())

            def loss(t: float) -> float:
                z = raw / t
                z = z - z.max(axis=1, keepdims=True)
                return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(held)), truth[held]]).mean())

            self.temperature = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0, 5.0), key=loss)
        self._fit(samples, truth, np.arange(len(truth)), rounds)

    def _fit(self, samples: list[np.ndarray], truth: np.ndarray, chosen: np.ndarray, rounds: int, rate: float = 0.3) -> None:
        """Adaptive gradient steps over shuffled lots of the chosen samples."""
        self.weights[:] = 0
        seen = np.full_like(self.weights, 1e-6)
        rng = np.random.default_rng(0)
        for _ in range(rounds):
            order = rng.permutation(chosen)
            for low in range(0, len(order), 128):
                lot = order[low : low + 128]
                sizes = np.array([len(samples[n]) for n in lot])
                scale = np.sqrt(sizes)
                flat = np.concatenate([samples[n] for n in lot])
                z = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes) / scale[:, None]
                error = np.exp(z - z.max(axis=1, keepdims=True))
                error /= error.sum(axis=1, keepdims=True)
                error[np.arange(len(lot)), truth[lot]] -= 1
                rows = np.repeat(error / scale[:, None], sizes, axis=0)
                used, inverse = np.unique(flat, return_inverse=True)
                step = np.stack([np.bincount(inverse, rows[:, k], len(used)) for k in range(rows.shape[1])], axis=1)
                seen[used] += step**2
                self.weights[used] -= rate * step / np.sqrt(seen[used])

    def _scores(self, found: np.ndarray) -> np.ndarray:
        return self.weights[found].sum(axis=0) / np.sqrt(len(found))

    def posterior(self, found: np.ndarray) -> np.ndarray:
        z = self._scores(found) / self.temperature + self.prior
        z = np.exp(z - z.max())
        return z / z.sum()


def _projected(start: np.ndarray, member: np.ndarray, cap: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The moved rates as they are, and projected into their range."""
    moved = start + member @ moves
    return moved, np.clip(moved, 0.0, cap)


def _mix(
    documents: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: int | None = None,
    tokenizer: str = TOKENIZER,
    rounds: int = 20,
    close_enough: float = 1e-3,
) -> tuple[DataFrame, list[str], float]:
    """doc_id, source_key, tokens, rate, copies, member; the domains of member; held-out accuracy."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    aims = {
        row["key"]: (float(row["share"] or 0.0), float(row["cap"] or 0))
        for row in targets.groupBy(source_key(F.col("source")).alias("key"))
        .agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
        .collect()
        if row["key"]
    }
    docs = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), source_key(F.col(source)).alias("key")
    ).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    aimed = F.col("key").isin(list(aims))
    domain = F.when(aimed, F.col("key")).when(F.col("key").isNotNull(), F.lit(OTHER))
    counts = {r["domain"]: r["n"] for r in docs.groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n")).collect() if r["domain"]}
    # A sample of each domain by hash of the document; its features, not its texts, go to the driver.
    share = max(1, min(SAMPLE_PER_DOMAIN, SAMPLE_TOTAL // max(1, len(counts))))
    parts = F.lit(0)
    for name, count in counts.items():
        parts = F.when(domain == name, min(1 << 30, -(-share * (1 << 30) // count))).otherwise(parts)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < parts).select("doc_id", "text", domain.alias("domain"))

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(tokenizer)
        for batch in batches:
            rows: list[np.ndarray] = []
            for body in batch["text"]:
                found, _ = features(code, body)
                if len(found) > SAMPLE_TOKENS:
                    ids, n = np.unique(code.encode_to_numpy(body, disallowed_special=()), return_counts=True)
                    found = np.concatenate([ids[np.argsort(-n, kind="stable")[: SAMPLE_TOKENS - 3]].astype("i8"), found[-3:]])
                rows.append(found.astype("i4"))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "domain": batch["domain"], "found": rows})

    kind = dict(docs.dtypes)["doc_id"]
    sample = drawn.mapInPandas(sampled, f"doc_id {kind}, domain string, found array<int>").toPandas()
    sample = sample.sort_values(["doc_id", "domain"], kind="stable").sample(frac=1.0, random_state=0)
    model = DomainModel([np.asarray(f, "i8") for f in sample["found"]], list(sample["domain"]), counts)
    shared = spark.sparkContext.broadcast(model)
    width = len(model.domains)
    labels = [d for d in model.domains if d != OTHER]
    by_text = {d: n for n, d in enumerate(model.domains)}
    place = {d: width + n for n, d in enumerate(labels)}
    caps = {key: cap for key, (share, cap) in aims.items() if share > 0}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(tokenizer)
        for batch in batches:
            tokens, member = [], []
            for body in batch["text"]:
                found, count = features(code, body)
                tokens.append(count)
                member.append(shared.value.posterior(found).astype("f4") if width else np.zeros(0, "f4"))
            cap = [caps.get(key, 0.0) for key in batch["key"]]
            label = [place.get(key, 0) for key in batch["key"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "key": batch["key"], "tokens": tokens, "cap": cap, "label": label, "member": member}
            )

    measured = scratch.keep(
        docs.mapInPandas(measure, f"doc_id {kind}, key string, tokens bigint, cap double, label int, member array<float>"), "docs"
    )
    mixable = measured.where(F.col("cap") > 0)
    reach = [F.sum(F.col("tokens") * F.col("cap") * F.col("member")[n]).alias(f"d{n}") for n in range(width)]
    sizes: dict[str, float] = {}
    expected = np.zeros(width)
    for row in mixable.groupBy("key").agg(F.sum("tokens").alias("tokens"), *reach).collect():
        sizes[row["key"]] = float(row["tokens"] or 0)
        expected += np.array([row[f"d{n}"] or 0.0 for n in range(width)])
    open_keys = [k for k in labels if sizes.get(k, 0) > 0 and aims[k][0] > 0 and aims[k][1] > 0]
    reachable = sum(aims[k][0] for k in open_keys)
    if total_tokens is None:
        most = {k: min(aims[k][1] * sizes[k], expected[by_text[k]]) for k in open_keys}
        total = min((most[k] / (aims[k][0] / reachable) for k in open_keys), default=0.0)
    else:
        total = float(total_tokens)
    goal = np.zeros(width + len(labels))
    for k in open_keys:
        goal[place[k]] = goal[by_text[k]] = aims[k][0] / reachable * total
    size = width + len(labels)
    start = np.zeros(size + 1)
    for k in open_keys:
        start[place[k]] = min(aims[k][1], aims[k][0] / reachable * total / sizes[k])
    aimed_at = np.flatnonzero(goal > 0)
    loose = 1e-6 * sum(sizes.values()) / max(1, len(aimed_at))

    def both(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Membership by text and by label, the rates to start from, and the most they may be."""
        label = batch.column("label").to_numpy()
        member = np.zeros((batch.num_rows, size))
        member[:, :width] = batch.column("member").flatten().to_numpy().reshape(batch.num_rows, width)
        labelled = np.flatnonzero(label)
        member[labelled, label[labelled]] = 1.0
        return member, start[label], batch.column("cap").to_numpy()

    def sums(tried: np.ndarray):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total_of = np.zeros((len(tried), 1 + len(aimed_at) + len(aimed_at) ** 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                member, first, cap = both(batch)
                tokens, member = batch.column("tokens").to_numpy().astype("f8"), member[:, aimed_at]
                for sums, moves in zip(total_of, tried):
                    moved, rates = _projected(first, member, cap, moves)
                    free = tokens * ((moved > 0) & (moved < cap))
                    sums[0] += tokens @ (rates * moved - rates * rates / 2)
                    sums[1 : 1 + len(aimed_at)] += (tokens * rates) @ member
                    sums[1 + len(aimed_at) :] += (member.T @ (member * free[:, None])).ravel()
            flat = total_of.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype="i4")), pa.array(flat)], names=["n", "value"])

        return scan

    moves = np.zeros(len(aimed_at))
    at, nearest, idle = None, np.inf, 0
    tried = moves[None, :]
    for _ in range(rounds if len(aimed_at) and total > 0 else 0):
        table = np.zeros((len(tried), 1 + len(aimed_at) + len(aimed_at) ** 2))
        gathered = mixable.select("tokens", "cap", "label", "member").mapInArrow(sums(tried), "n int, value double")
        for row in gathered.groupBy("n").agg(F.sum("value").alias("value")).collect():
            table.flat[row["n"]] = row["value"]
        heights = table[:, 0] - tried @ goal[aimed_at] + loose / 2 * (tried**2).sum(axis=1)
        low = int(heights.argmin())
        if at is not None and heights[low] >= at:
            break
        at, moves = heights[low], tried[low]
        missing = goal[aimed_at] - table[low, 1 : 1 + len(aimed_at)]
        furthest = float(np.abs(missing).max() / total)
        idle = 0 if furthest < 0.97 * nearest else idle + 1
        nearest = min(nearest, furthest)
        if furthest <= close_enough or idle >= 4:
            break
        curve = table[low, 1 + len(aimed_at) :].reshape(len(aimed_at), len(aimed_at))
        ridge = np.eye(len(aimed_at)) * (loose + 1e-4 * np.trace(curve) / len(aimed_at) + 1e-9)
        step = np.linalg.solve(curve + ridge, missing - loose * moves)
        tried = moves + np.array([[1.0], [0.3], [0.1], [0.02]]) * step

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                member, first, cap = both(batch)
                rates = _projected(first, member[:, aimed_at], cap, moves)[1]
                columns = [batch.column("doc_id"), batch.column("key"), batch.column("tokens"), pa.array(rates), batch.column("member")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source_key", "tokens", "rate", "member"])

    out = measured.mapInArrow(rated, f"doc_id {kind}, source_key string, tokens bigint, rate double, member array<float>")
    cells = max(64, -(-sum(counts.values()) // CELL))
    return _whole_copies(scratch.keep(out, "rates"), cells), model.domains, model.accuracy


def mix_rates(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """doc_id, source_key, tokens, rate, copies: how often each document is in the mix.

    Options: doc_id, text, source (names of columns), total_tokens (size of the mix),
    tokenizer (path of the vocabulary), rounds and close_enough (of the fit).
    """
    return _mix(documents, targets, **options)[0].drop("member")


def _whole_copies(rates: DataFrame, buckets: int) -> DataFrame:
    """Adds copies: the rates made whole by systematic sampling within each source.

    Documents of a source are lined up by size class and hash; a copy is added
    wherever the running sum of the fractions passes a whole number, so the copies of
    every stretch, and nearly its tokens, match the rates. The running sum is taken
    from sums per cell (source, size class, one of ``buckets`` of the hash), so no source
    is one task.
    """
    fraction = F.col("rate") - F.floor("rate")
    cells = rates.where(F.col("rate") > 0).withColumns(
        {
            "fraction": fraction,
            "size_class": F.floor(F.log2(F.greatest("tokens", F.lit(1)).cast("double")) * 4).cast("int"),
            "cell": F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(buckets)).cast("int"),
        }
    )
    keys = ["source_key", "size_class", "cell"]
    ahead = Window.partitionBy("source_key").orderBy("size_class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy(*keys)
        .agg(F.sum("fraction").alias("whole"))
        .select(*keys, F.coalesce(F.sum("whole").over(ahead), F.lit(0.0)).alias("before"))
    )
    inside = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    running = F.col("before") + F.sum("fraction").over(inside)
    chosen = cells.join(offsets, keys).withColumn("upto", running)
    extra = F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("fraction") + 0.5)
    columns = ["doc_id", "source_key", "tokens", "rate", "member"]
    copies = chosen.select(*columns, (F.floor("rate") + extra).cast("int").alias("copies"))
    none = rates.where(~(F.col("rate") > 0)).select(*columns, F.lit(0).alias("copies"))
    return copies.unionByName(none)


def mix_shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """source, target_share, max_repeats, documents, tokens, mixed_tokens, most_copies, reached_share, expected_share.

    reached_share: of the tokens of the mix, those of the documents labelled with the
    source. expected_share: those that the classifier expects to belong to it.
    """
    rates, domains, _ = _mix(documents, targets, **options)
    mixed = F.col("tokens") * F.col("copies")
    spread = [F.sum(mixed * F.col("member")[n]).alias(f"d{n}") for n in range(len(domains))]
    by_source = rates.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("tokens").alias("tokens"),
        F.sum(mixed).alias("mixed_tokens"),
        F.max("copies").alias("most_copies"),
        *spread,
    )
    by_source = Scratch(documents.sparkSession, "shares").keep(by_source, "sources")
    totals = by_source.agg(F.sum("mixed_tokens").alias("whole"), *(F.sum(f"d{n}").alias(f"d{n}") for n in range(len(domains))))
    listed = F.array(*(F.struct(F.lit(d).alias("source_key"), F.col(f"d{n}").alias("expected")) for n, d in enumerate(domains)))
    expected = totals.select(F.explode(listed).alias("one")).select("one.*") if domains else None
    aims = targets.groupBy(source_key(F.col("source")).alias("source_key")).agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    joined = aims.join(by_source.drop(*(f"d{n}" for n in range(len(domains)))), "source_key", "left")
    joined = joined.join(expected, "source_key", "left") if domains else joined.withColumn("expected", F.lit(None).cast("double"))
    whole = F.nullif(F.sum("mixed_tokens").over(Window.partitionBy()), F.lit(0))
    return joined.withColumn("whole", whole).select(
        F.col("source_key").alias("source"),
        "target_share",
        "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("mixed_tokens") / F.col("whole"), F.lit(0.0)).alias("reached_share"),
        F.coalesce(F.col("expected") / F.col("whole"), F.lit(0.0)).alias("expected_share"),
    )

from pathlib import Path

import numpy as np
import pytest
from conftest import rows_of

from lumenfold.llm import similar
from lumenfold.llm.similar import learn_rotations, most_similar, plan_code, similar_pairs

SCHEMA = "id bigint, model string, vec array<float>"


def clusters(count, dim, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((count // 6 + 1, dim))
    return [(centres[n // 6] + spread * rng.standard_normal(dim)).astype("f4") for n in range(count)]


def brute(rows, k, floor):
    usable = {}
    for number, model, vec in rows:
        if number is None or vec is None or len(vec) == 0 or None in list(vec):
            continue
        wide = np.asarray(vec, "f8")
        if np.isfinite(wide).all() and wide @ wide > 0:
            usable[(number, model, len(vec))] = wide / np.sqrt(wide @ wide)
    out = set()
    for (a, model, dim), u in usable.items():
        scores = [(-round(float(u @ v), 6), b) for (b, m, d), v in usable.items() if (m, d) == (model, dim) and b != a]
        for score, b in sorted(scores)[:k]:
            if -score >= floor:
                out.add((min(a, b), max(a, b)))
    return out


def test_finds_nearly_all_and_invents_none(spark):
    rows = [(n, "m", v.tolist()) for n, v in enumerate(clusters(600, 48, 1))]
    rows += [(n + 5000, "other", v.tolist()) for n, v in enumerate(clusters(60, 16, 2))]
    want = brute(rows, 5, 0.9)
    found = rows_of(similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", "model", "vec"))
    assert len(found & want) >= 0.98 * len(want) > 300
    assert len(found - want) <= 0.02 * len(found)


def test_unusable_vectors_and_copies(spark):
    base = np.arange(1, 17, dtype="f4")
    rows = [(n, "m", (base * 2).tolist()) for n in range(40)]
    rows += rows[:5]
    rows += [(90, "m", (-base).tolist()), (91, "m", None), (92, "m", []), (93, "m", [0.0] * 16), (94, "m", [float("nan")] * 16)]
    rows += [(95, "m", [float("inf")] * 16), (96, None, base.tolist()), (97, "m", base[:8].tolist()), (None, "m", base.tolist())]
    found = most_similar(spark.createDataFrame(rows, SCHEMA), "id", "model", "vec", k=5)
    per = {}
    for number, other, rank in rows_of(found, "id", "other", "rank"):
        per.setdefault(number, {})[rank] = other
    assert set(per) == set(range(40))
    assert list(dict(sorted(per[0].items())).values()) == [1, 2, 3, 4, 5]
    assert list(dict(sorted(per[20].items())).values()) == [0, 1, 2, 3, 4]


def test_hot_bucket_is_compared_in_blocks(spark, monkeypatch):
    rows = [(n, "m", v.tolist()) for n, v in enumerate(clusters(300, 32, 3, spread=0.02))]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5, 0.9)
    monkeypatch.setattr(similar, "HOT_BUCKET", 8)
    found = rows_of(similar_pairs(frame, "id", "model", "vec"))
    assert len(found & want) >= 0.98 * len(want)


def test_empty_and_wrong_parameters(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert similar_pairs(none, "id", "model", "vec").count() == 0
    with pytest.raises(ValueError):
        most_similar(none, "id", "model", "vec", k=0)


def test_plan_and_rotation():
    s, m = plan_code(1_000_000, 0.9, 0.97)
    assert 16 <= s <= 20 and m * s < 400
    assert plan_code(100, 0.99, 0.97)[1] < plan_code(100, 0.8, 0.97)[1]
    sample = np.random.default_rng(0).standard_normal((300, 8))
    _, turn = learn_rotations(sample, 20, 0)
    assert turn.shape == (8, 20)
    assert np.allclose(turn[:, :8].T @ turn[:, :8], np.eye(8), atol=1e-8)


def test_hot_and_cold_buckets_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((300, 6)) * [3, 2, 1, 1, 1, 1] + [1, 0.5, 0, 0, 0, 0]
    frame = spark.createDataFrame([(n, "m", v.astype("f4").tolist()) for n, v in enumerate(vectors)], SCHEMA)
    monkeypatch.setattr(similar, "plan_code", lambda *_: (3, 1))

    def found():
        return rows_of(most_similar(frame, "id", "model", "vec", min_cosine=0.6, sketch_sigmas=100.0), "id", "other", "rank")

    cold = found()
    for hot_bucket in (30, 40, 50):
        monkeypatch.setattr(similar, "HOT_BUCKET", hot_bucket)
        assert found() == cold


def shuffled(spark):
    """Bytes of shuffle files that are on disk now."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for folder in folders for f in Path(folder).rglob("shuffle_*.data"))


def test_shuffles_do_not_pile_up(spark):
    vectors = clusters(6000, 64, 5)
    frame = spark.createDataFrame([(n, "m", v.tolist()) for n, v in enumerate(vectors)], SCHEMA)
    before = shuffled(spark)
    found = similar_pairs(frame, "id", "model", "vec")
    assert shuffled(spark) - before < 0.5 * sum(v.nbytes for v in vectors)
    assert found.count() > 6000


def test_passes_and_parts_change_no_row(spark, monkeypatch):
    rows = [(n, "m", v.tolist()) for n, v in enumerate(clusters(900, 24, 6, spread=0.12))]
    rows += [(n + 5000, "other", v.tolist()) for n, v in enumerate(clusters(90, 8, 7))]
    frame = spark.createDataFrame(rows, SCHEMA)

    def found():
        return rows_of(most_similar(frame, "id", "model", "vec", min_cosine=0.8), "grp", "id", "other", "rank")

    whole = found()
    for name, value in (("PART_BYTES", 4_000), ("PASS_BYTES", 1), ("PASS_SHARE", 0.4), ("CODE_BYTES", 5_000), ("PAIRS_AT_ONCE", 7)):
        monkeypatch.setattr(similar, name, value)
    assert found() == whole
    assert len(whole) > 3000


def test_meetings_are_all_rows_up_to_one_bit_apart():
    rng = np.random.default_rng(8)
    sub, bits, cut = rng.integers(0, 32, 60), 5, 2
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if int(sub[a] ^ sub[b]).bit_count() <= 1}
    counts = np.bincount(sub, minlength=32)
    for hot in (1, 2, 100):
        got = []
        for part in range(1 << cut):
            home = [(u, -1, n) for n, u in enumerate(sub) if u >> (bits - cut) == part]
            sent = [(u | 1 << b, b, n) for n, u in enumerate(sub) for b in range(bits - cut, bits) if not u >> b & 1]
            own = home + [x for x in sent if x[0] >> (bits - cut) == part]
            rows = np.zeros(len(own), similar._row_type(1))
            for at, (u, flip, n) in enumerate(sorted(own, key=lambda x: (x[1], x[0]))):
                rows[at]["sub"], rows[at]["flip"], rows[at]["rep"] = u, flip, n
            for one, two in similar._meetings(rows, bits - cut, hot):
                got += [(min(a, b), max(a, b)) for a, b in zip(rows["rep"][one].tolist(), rows["rep"][two].tolist())]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a, b in want if counts[sub[a]] <= hot or counts[sub[b]] <= hot}

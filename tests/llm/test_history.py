import random
import unicodedata

import numpy as np
from conftest import rows_of
from pyspark.sql import functions as F

from lumenfold.llm import history
from lumenfold.llm.history import HistoryStore, dedup_arrivals, dedup_inbox, minwise, path_key, record_ledger
from lumenfold.session import Scratch

LEDGER = "id bigint, path string, status string, phash bigint, taken_at string"
INBOX = "id bigint, batch_no int, path string, phash bigint, taken_at string, status string"


def brute(ledger, inbox):
    def key(path):
        if path is None or not path.strip():
            return None
        out = unicodedata.normalize("NFC", path.casefold())
        while "/./" in out or "//" in out:
            out = out.replace("/./", "/").replace("//", "/")
        return out

    def second(text):
        try:
            h, m, s = text[11:19].split(":")
            return (text[:10], int(h) * 3600 + int(m) * 60 + int(s))
        except (TypeError, ValueError):
            return None

    accepted = [(i, key(p), h, second(t)) for i, p, status, h, t in set(ledger) if status in ("canonical", "promoted")]
    out = set()
    for i, batch, p, h, t, _ in sorted(set(inbox), key=lambda r: (r[1], r[0])):
        met = set()
        for j, q, g, u in accepted:
            near = None not in (h, g, second(t), u) and (h ^ g).bit_count() <= 6 and u[0] == second(t)[0] and abs(u[1] - second(t)[1]) <= 2
            if (key(p) is not None and key(p) == q) or near:
                met.add((j, i))
        out |= met
        if not met:
            accepted.append((i, key(p), h, second(t)))
    return out


def example(seed, count=150):
    rng = random.Random(seed)
    prints = [rng.getrandbits(62) for _ in range(12)]

    def one(number):
        h = rng.choice(prints)
        for _ in range(rng.randrange(6)):
            h ^= 1 << rng.randrange(62)
        path = rng.choice([f"/a/{rng.randrange(40)}.jpg", f"/A//{rng.randrange(40)}.JPG", f"/a/./{rng.randrange(40)}.jpg", f"/ü/{number}.jpg"])
        taken = rng.choice([f"2020-01-01T00:00:{rng.randrange(10, 30)}", None, "void"])
        return path, rng.choice([h, h, None]), taken

    ledger = []
    for n in range(40):
        path, h, taken = one(n)
        ledger.append((n, path, rng.choice(["canonical", "promoted", "error"]), h, taken))
    inbox = []
    for n in range(count):
        path, h, taken = one(n)
        inbox.append((1000 + n, n // 30, path, h, taken, "new"))
    return ledger + ledger[:5], inbox + inbox[:5]


def test_against_brute_force(spark):
    for seed in (1, 2):
        ledger, inbox = example(seed)
        found = dedup_inbox(spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(inbox, INBOX))
        want = brute(ledger, inbox)
        assert len(want) > 50 and rows_of(found, "known_id", "new_id") == want


def test_batch_after_batch_equals_all_at_once(spark):
    ledger, inbox = example(3)
    store = HistoryStore(spark, Scratch(spark, "t").path("store"))
    record_ledger(store, spark.createDataFrame(ledger, LEDGER))
    found = set()
    for batch in range(5):
        part = [r for r in inbox if r[1] == batch]
        found |= rows_of(dedup_arrivals(store, spark.createDataFrame(part, INBOX)), "known_id", "new_id")
    assert found == brute(ledger, inbox)


def test_hot_copies_stay_linear(spark):
    inbox = [(n, 1, "/same.jpg", 5, "2020-01-01T00:00:10", "new") for n in range(400)]
    found = rows_of(dedup_inbox(spark.createDataFrame([], LEDGER), spark.createDataFrame(inbox, INBOX)), "known_id", "new_id")
    assert found == {(0, n) for n in range(1, 400)}


def test_path_key(spark):
    paths = ["/A/./b//C.jpg", "/a/b/c.jpg/", "/Ü.jpg", "/Ü.JPG", None, "  ", ""]
    df = spark.createDataFrame([(n, p) for n, p in enumerate(paths)], "n int, path string")
    keys = dict(rows_of(df.select("n", path_key(F.col("path")))))
    assert keys[0] == keys[1] == "/a/b/c.jpg" and keys[2] == keys[3] == "/ü.jpg"
    assert keys[4] is keys[5] is keys[6] is None


def test_empty(spark):
    assert dedup_inbox(spark.createDataFrame([], LEDGER), spark.createDataFrame([], INBOX)).count() == 0


def test_minwise_hashes_agree_as_the_sets_overlap():
    rng = np.random.default_rng(0)
    one = rng.integers(-(2**63), 2**63 - 1, 4_000)
    for bits in (0, 3, 6, 20):
        two = one.copy()
        for n in range(len(two)):
            for place in rng.choice(64, bits, replace=False):
                two[n] ^= np.int64(1) << np.int64(place)
        same = (minwise(one) == minwise(two)).mean()
        assert abs(same - (64 - bits) / (64 + bits)) < 0.02


def test_minwise_by_brute_force():
    tables = history.minwise_tables()
    value = 0x0123456789ABCDEF
    for n, got in enumerate(minwise(np.array([value]))[0]):
        assert got == min(tables[n, byte, value >> 8 * byte & 255] for byte in range(8))


def test_bands_meet_near_pairs(spark):
    """Of pairs at six bits in one second, the share that the bands lose is what minwise hashing promises."""
    rng = random.Random(9)
    rows = []
    for n in range(8_000):
        h = rng.getrandbits(63)
        g = h
        for place in rng.sample(range(63), 6):
            g ^= 1 << place
        rows += [(2 * n, n, h), (2 * n + 1, n, g)]
    hashes = minwise(np.array([r[2] for r in rows]))
    bands = [[tuple(h[k * history.ROWS : (k + 1) * history.ROWS]) for k in range(history.BANDS)] for h in hashes]
    lost = sum(not any(a == b for a, b in zip(bands[2 * n], bands[2 * n + 1])) for n in range(8_000))
    assert lost <= 6


def test_batches_run_again_give_the_same(spark):
    ledger, inbox = example(4)
    store = HistoryStore(spark, Scratch(spark, "t").path("store"))
    record_ledger(store, spark.createDataFrame(ledger, LEDGER))
    first = [rows_of(dedup_arrivals(store, spark.createDataFrame([r for r in inbox if r[1] == b], INBOX)), "known_id", "new_id") for b in range(5)]
    rows = store.read().count()
    again = rows_of(dedup_arrivals(store, spark.createDataFrame([r for r in inbox if r[1] == 2], INBOX)), "known_id", "new_id")
    assert again == first[2] and store.read().count() == rows and len(store.segments()) == 6
    store.compact("1-000000000003")
    assert len(store.segments()) == 3 and store.read().count() == rows
    last = rows_of(dedup_arrivals(store, spark.createDataFrame([r for r in inbox if r[1] == 4], INBOX)), "known_id", "new_id")
    assert last == first[4]


def test_a_small_batch_reads_few_parts(spark, monkeypatch):
    monkeypatch.setattr(history, "PART_ROWS", 20)
    rng = random.Random(2)
    ledger = [(n, f"/p/{n}.jpg", "canonical", rng.getrandbits(62), f"2020-01-0{1 + n % 9}T00:{n % 60:02d}:10") for n in range(600)]
    store = HistoryStore(spark, Scratch(spark, "t").path("store"))
    record_ledger(store, spark.createDataFrame(ledger, LEDGER))
    assert store.segments() == {"0-ledger": 512}
    asked = spark.createDataFrame([(-17,)], "key bigint")
    files = store.read(asked=asked).inputFiles()
    assert len(files) <= 1
    found = dedup_arrivals(store, spark.createDataFrame([(9000, 1, "/p/7.jpg", None, None, "new")], INBOX))
    assert rows_of(found, "known_id", "new_id") == {(7, 9000)}

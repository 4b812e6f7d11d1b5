import random
from difflib import SequenceMatcher

from conftest import rows_of

from lumenfold.queries.catalog import QUERIES


def test_word_ratios_of_the_next_caption(spark, tmp_path):
    rng = random.Random(5)
    words = "lake hill rain walk boat dawn".split()
    rows = []
    for n in rng.sample(range(1, 9_000), 400):
        text = None if n % 50 == 0 else " ".join(rng.choice(words) for _ in range(6))
        rows.append((n, text, rng.choice(["caption", "Caption", "caption ", "howto"])))
    frame = spark.createDataFrame([*rows, *rows[:20], (None, "no id", "caption")], "doc_id bigint, text string, source string")
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    captions = sorted((n, text) for n, text, source in rows if source != "howto")
    want = set()
    for (n, one), (_, two) in zip(captions, captions[1:]):
        both = one is not None and two is not None
        want.add((n, round(SequenceMatcher(None, one.split(), two.split()).ratio(), 3) if both else None))
    found = QUERIES["word_ratios"](spark, str(tmp_path))
    assert rows_of(found) == want and found.count() == len(captions) - 1

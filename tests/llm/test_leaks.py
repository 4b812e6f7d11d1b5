import random

from conftest import rows_of

from lumenfold.llm import leaks
from lumenfold.llm.leaks import Automaton, find_leaks, remove_leaks, words_of

DOCS = "doc_id bigint, text string, item_id bigint"
ITEMS = "item_id bigint, text string, doc_id bigint"


def brute(docs, items, least):
    out = set()
    for d, text, *_ in docs:
        words = words_of(text)
        runs = {tuple(words[n : n + least]) for n in range(len(words) - least + 1)}
        for i, item, *_ in items:
            other = words_of(item)
            if any(tuple(other[n : n + least]) in runs for n in range(len(other) - least + 1)):
                out.add((d, i))
    return out


def example(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefg")
    items = [(n, " ".join(word() for _ in range(rng.randrange(3, 30))), 0) for n in range(25)]
    docs = []
    for n in range(80):
        text = [word() for _ in range(rng.randrange(0, 40))]
        if n % 3 == 0:
            source = words_of(rng.choice(items)[1])
            text[5:5] = source[: rng.randrange(1, 20)]
        docs.append((n, " ".join(text), 0))
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = example(1)
    want = brute(docs, items, 8)
    assert 5 < len(want) < 1500
    for words, at_once in ((1_000_000, 8), (60, 3)):
        monkeypatch.setattr(leaks, "BLOCK_WORDS", words)
        monkeypatch.setattr(leaks, "BLOCKS_AT_ONCE", at_once)
        found = find_leaks(spark.createDataFrame(docs + docs[:3], DOCS), spark.createDataFrame(items + items[:2], ITEMS), least_words=8)
        assert rows_of(found, "doc_id", "item_id") == want


def test_spelling_does_not_count(spark):
    item = "The half-drowned lantern, near an Ümlaut café, stands still behind some old tall mill."
    docs = [
        (1, item.upper().replace(",", " –"), 0),
        (2, item.replace("é", "é").replace(" ", "  "), 0),
        (3, "1\n00:00:01,000 --> 00:00:02,000\nThe half-drowned lantern, near an Ümlaut\n\n2\n00:00:03,000 --> 00:00:04,000\ncafé, stands still behind some old", 0),
        (4, "half drowned lantern near an other Ümlaut café stands still behind some old tall", 0),
        (5, None, 0),
        (6, "", 0),
        (7, "x " * 50_000 + item, 0),
    ]
    found = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(9, item, 0), (8, None, 0), (7, "too short", 0)], ITEMS))
    assert rows_of(found, "doc_id", "item_id") == {(1, 9), (2, 9), (3, 9), (7, 9)}


def test_removal_and_coverage(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, f"Before it. {item}. And a lot of other words that come after it, more than half of all here are clean ones."), (2, item), (3, "Clean  text.")]
    frame = spark.createDataFrame([(a, b, 0) for a, b in docs], DOCS)
    found = {d: (t, c) for d, t, c in rows_of(remove_leaks(frame, spark.createDataFrame([(9, item, 0)], ITEMS)))}
    assert set(found) == {1, 3} and found[3] == ("Clean  text.", 0.0)
    assert "seven" not in found[1][0] and "before it" in found[1][0] and 0.3 < found[1][1] < 0.5


def test_empty(spark):
    assert find_leaks(spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_longest_match():
    automaton = Automaton.build([(1, list("abcde")), (2, list("xbcdy"))], 2)
    assert [(n, size) for n, size, _ in automaton.matches(list("zabcdyq"), 2)] == [(2, 2), (3, 3), (4, 4), (5, 4)]
    assert list(automaton.matches(list("bc"), 2))[0][2] == (1, 2)


def test_automaton_against_plain_search():
    """Longest matches and their items, on a small alphabet, in one go and in short stretches, after a round trip through bytes."""
    import numpy as np

    rng = random.Random(8)
    for least in (1, 3):
        items = [(n, [rng.choice("abc") for _ in range(rng.randrange(1, 14))]) for n in range(12)]
        automaton = Automaton.load(memoryview(Automaton.build(items, least).save()))
        inside = {tuple(w[a:b]): set() for _, w in items for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        for n, w in items:
            for a in range(len(w)):
                for b in range(a + 1, len(w) + 1):
                    inside[tuple(w[a:b])].add(n)
        texts = [[rng.choice("abcd") for _ in range(rng.randrange(0, 60))] for _ in range(20)]
        want = {}
        for d, words in enumerate(texts):
            for n in range(len(words)):
                size = max((k for k in range(1, n + 2) if tuple(words[n + 1 - k : n + 1]) in inside), default=0)
                if size >= least:
                    want[d, n] = (size, tuple(sorted(inside[tuple(words[n + 1 - least : n + 1])])))
        for d, words in enumerate(texts):
            assert {(d, n): (size, held) for n, size, held in automaton.matches(words, least)} == {k: v for k, v in want.items() if k[0] == d}
        for stretch in (14, 1_000):
            leaks.STRETCH_WORDS, before = stretch, leaks.STRETCH_WORDS
            (found,) = leaks._found([automaton], texts, 14, least)
            leaks.STRETCH_WORDS = before
            best: dict = {}
            for d, n, size in zip(*(np.asarray(x).tolist() for x in found[1:4])):
                best[d, n] = max(best.get((d, n), 0), size)
            assert best == {k: v[0] for k, v in want.items()}


def test_automaton_is_compact():
    rng = random.Random(0)
    items = [(n, [f"w{rng.randrange(20_000)}" for _ in range(200)]) for n in range(100)]
    assert len(Automaton.build(items, 12).save()) < 150 * 20_000

"""Evaluation texts leaking into training text, by a generalised suffix automaton.

The held-out items are cut to words (Unicode form, case, punctuation and spacing made
even) and put into one automaton over word numbers. Each document is streamed
through it once; the state tells the longest match that ends at each word, and the
items that hold its last ``least_words`` words have leaked.

An automaton is a handful of flat arrays: a hash table of (state, word) steps, links,
lengths and item lists, about 100 bytes a word of the items. Items come in blocks of about
BLOCK_WORDS words, each built by one task and written to the shared folder; up to
BLOCKS_AT_ONCE of them are broadcast, so what is sent has a bound whatever the items,
and one pass streams every document through all of these. Documents of a batch move
through the automaton side by side, one word of each at a time.

Defined results: null and empty texts hold nothing; items of fewer words than
``least_words`` cannot leak; cue numbers and timing lines of subtitles count as
spacing; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Words of the items in one automaton, and automata that one pass over the documents applies.
BLOCK_WORDS = 250_000
BLOCKS_AT_ONCE = 8
#: Bytes of a part in which an automaton is stored.
PIECE = 32 << 20
#: Words of one stretch of a document; a longer one is read in stretches that overlap by the longest item.
STRETCH_WORDS = 4_096

_WORD = re.compile(r"[^\W_]+")
_CUE = re.compile(r"(?m)^[ \t]*(?:\d+[ \t]*\r?\n)?[ \t]*\d{2}:\d{2}:\d{2}[,.]\d{3} --> \d{2}:\d{2}:\d{2}[,.]\d{3}.*$")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def even(text: str) -> str:
    """The text with one Unicode form and letter case, without invisible characters and cue lines."""
    if "-->" in text:
        text = _CUE.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).casefold())
        return text
    return text.lower()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(even(text)) if text else []


#: Codes of words seen by this process, at most KNOWN_WORDS.
_CODES: dict[str, int] = {}
KNOWN_WORDS = 500_000


def word_codes(words: list[str]) -> np.ndarray:
    """A 64-bit number of each word."""
    import xxhash

    found = list(map(_CODES.get, words))
    if None in found:
        if len(_CODES) > KNOWN_WORDS:
            _CODES.clear()
        for word in set(words) - _CODES.keys():
            _CODES[word] = xxhash.xxh3_64_intdigest(word)
        found = list(map(_CODES.get, words))
    return np.array(found, "u8")


class _Builder:
    """Suffix automaton under construction: steps in one dictionary, their words in a chain per state."""

    def __init__(self):
        self.step: dict[int, int] = {}
        self.words: list[list[int]] = [[]]
        self.link, self.length = [-1], [0]

    def add(self, last: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        follow = step.get(last << 32 | word)
        if follow is not None:
            return follow if length[follow] == length[last] + 1 else self._split(last, word, follow)
        new = len(link)
        self.words.append([])
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and (follow := step.get(at << 32 | word)) is None:
            step[at << 32 | word] = new
            self.words[at].append(word)
            at = link[at]
        if at >= 0:
            link[new] = follow if length[follow] == length[at] + 1 else self._split(at, word, follow)
        return new

    def _split(self, at: int, word: int, follow: int) -> int:
        step, link = self.step, self.link
        copy = len(link)
        self.words.append(list(self.words[follow]))
        for other in self.words[follow]:
            step[copy << 32 | other] = step[follow << 32 | other]
        self.length.append(self.length[at] + 1)
        link.append(link[follow])
        link[follow] = copy
        while at >= 0 and step.get(at << 32 | word) == follow:
            step[at << 32 | word] = copy
            at = link[at]
        return copy


class Automaton:
    """Generalised suffix automaton as flat arrays.

    vocabulary: sorted word codes; keys and targets: hash table of steps; link, length: per
    state; first: where a state's items begin in ``items``. The items of a state are those
    of the last ``least_words`` words of its matches.
    """

    ARRAYS = ("vocabulary", "keys", "targets", "link", "length", "first", "items")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.shift = np.uint64(64 - (len(self.keys).bit_length() - 1))

    @classmethod
    def build(cls, items: list[tuple[int, list[str]]], least_words: int) -> Automaton:
        codes = [word_codes(words) for _, words in items]
        vocabulary = np.unique(np.concatenate(codes)) if codes else np.zeros(0, "u8")
        builder, ends = _Builder(), []
        for code in codes:
            last, path = 0, []
            for word in np.searchsorted(vocabulary, code).tolist():
                last = builder.add(last, word)
                path.append(last)
            ends.append(path)
        # Splits move words to other states, so holders are found on the finished automaton.
        link, length = np.array(builder.link, "i4"), np.array(builder.length, "i4")
        holders: dict[int, set[int]] = {}
        seen: dict[int, int] = {}
        for (number, _), code in zip(items, codes):
            state = 0
            for word in np.searchsorted(vocabulary, code).tolist():
                up = state = builder.step[state << 32 | word]
                while up > 0 and seen.get(up) != number:
                    seen[up] = number
                    # Only the shallowest state of least_words words or more reports.
                    if length[up] >= least_words > length[link[up]]:
                        holders.setdefault(up, set()).add(number)
                    up = int(link[up])
        reporter = np.zeros(len(link), "i4")
        for state in np.argsort(length, kind="stable").tolist():
            if length[state] >= least_words:
                reporter[state] = state if length[link[state]] < least_words else reporter[link[state]]
        counts = np.array([len(holders.get(int(r), ())) if r else 0 for r in reporter], "i8")
        lists = {state: len_before for state, len_before in zip(holders, np.cumsum([0, *(len(h) for h in holders.values())]))}
        flat = np.fromiter((n for h in holders.values() for n in sorted(h)), "i8")
        first = np.stack([np.array([lists.get(int(r), 0) for r in reporter], "i8"), counts], axis=1)
        size = 16
        while size < 2 * len(builder.step):
            size *= 2
        keys, targets = np.zeros(size, "u8"), np.zeros(size, "i4")
        want = np.fromiter(builder.step.keys(), "u8", len(builder.step)) + np.uint64(1)
        follow = np.fromiter(builder.step.values(), "i4", len(builder.step))
        place = cls._slots(want, np.uint64(64 - (size.bit_length() - 1)))
        left = np.arange(len(want))
        while len(left):
            # Of the steps that ask for one free slot the last wins; the others try the next slot.
            free = left[keys[place[left]] == 0]
            keys[place[free]] = want[free]
            targets[place[free]] = follow[free]
            left = left[keys[place[left]] != want[left]]
            place[left] = (place[left] + 1) % size
        return cls(
            {"vocabulary": vocabulary, "keys": keys, "targets": targets, "link": link, "length": length, "first": first, "items": flat}
        )

    @staticmethod
    def _slots(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype("i8")

    def word_numbers(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code in the vocabulary, -1 if it is not there."""
        if not len(self.vocabulary) or not len(codes):
            return np.full(len(codes), -1, "i8")
        place = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == codes, place, -1)

    def next_states(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The state that each step leads to, -1 without one."""
        want = (states.astype("u8") << np.uint64(32) | words.astype("u8")) + np.uint64(1)
        place = self._slots(want, self.shift)
        out = np.full(len(want), -1, "i4")
        left = np.arange(len(want))
        while len(left):
            found = self.keys[place[left]]
            hit = found == want[left]
            out[left[hit]] = self.targets[place[left[hit]]]
            left = left[~hit & (found != 0)]
            place[left] = (place[left] + 1) % len(self.keys)
        return out

    def stream(self, codes: np.ndarray, starts: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the last word, length, state) of every match of ``least_words`` words or more.

        ``codes``: the words of many texts in a row; ``starts``: where each begins. All
        texts move on by one word at a time; texts that are done drop out.
        """
        words = self.word_numbers(codes)
        ends = np.append(starts[1:], len(codes))
        order = np.argsort(starts - ends, kind="stable")
        at, stop = starts[order].astype("i8"), ends[order]
        state, size = np.zeros(len(at), "i4"), np.zeros(len(at), "i4")
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = int((at < stop).sum())
        while live:
            word = words[at[:live]]
            state[:live][word < 0] = 0
            size[:live][word < 0] = 0
            asking = np.flatnonzero(word >= 0)
            while len(asking):
                follow = self.next_states(state[asking], word[asking])
                met = asking[follow >= 0]
                state[met] = follow[follow >= 0]
                size[met] += 1
                lost = asking[follow < 0]
                deeper = state[lost] > 0
                size[lost[~deeper]] = 0
                asking = lost[deeper]
                state[asking] = self.link[state[asking]]
                size[asking] = self.length[state[asking]]
            long = np.flatnonzero(size[:live] >= least_words)
            if len(long):
                out.append((at[long], size[long], state[long]))
            at[:live] += 1
            live -= int((at[:live] >= stop[:live]).sum())
        if not out:
            return np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "i4")
        return tuple(np.concatenate(parts) for parts in zip(*out))

    def matches(self, words: list[str], least_words: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(index of the last word, length, items) of one text, in order."""
        place, size, state = self.stream(word_codes(words), np.zeros(1, "i8"), least_words)
        for n, length, s in sorted(zip(place.tolist(), size.tolist(), state.tolist())):
            low, count = self.first[s].tolist()
            yield n, length, tuple(self.items[low : low + count].tolist())

    def save(self) -> bytes:
        """The arrays in one buffer, each behind its name, kind and size, at places that a map can use."""
        parts, head = [], []
        offset = 4096
        for name in self.ARRAYS:
            array = np.ascontiguousarray(getattr(self, name))
            head.append(f"{name},{array.dtype.str},{'x'.join(map(str, array.shape))},{offset}")
            parts.append(array.tobytes() + b"\0" * (-array.nbytes % 64))
            offset += len(parts[-1])
        return ";".join(head).encode().ljust(4096, b"\0") + b"".join(parts)

    @classmethod
    def load(cls, buffer) -> Automaton:
        arrays = {}
        for entry in bytes(buffer[:4096]).rstrip(b"\0").decode().split(";"):
            name, kind, shape, offset = entry.split(",")
            sizes = [int(n) for n in shape.split("x")]
            arrays[name] = np.frombuffer(buffer, kind, int(np.prod(sizes)), int(offset)).reshape(sizes)
        return cls(arrays)


def _blocks(items: DataFrame, item_id: str, item_text: str, least_words: int) -> DataFrame:
    """block, longest, part, body: the automaton of each block of items in parts, and the words of its longest item."""
    held_out = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()
    )
    total = held_out.agg(F.coalesce(F.sum(F.size(F.split("text", r"[\W_]+"))), F.lit(0))).first()[0]
    count = max(1, -(-int(total) // BLOCK_WORDS))
    placed = held_out.distinct().withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(count)).cast("int"))

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        spelled = [(int(n), words_of(t)) for n, t in sorted(zip(batch["item_id"], batch["text"]))]
        body = Automaton.build(spelled, least_words).save()
        pieces = [body[k : k + PIECE] for k in range(0, len(body), PIECE)]
        longest = max(len(words) for _, words in spelled)
        return pd.DataFrame({"block": int(batch["block"].iloc[0]), "longest": longest, "part": range(len(pieces)), "body": pieces})

    made = placed.groupBy("block").applyInPandas(build, "block int, longest int, part int, body binary")
    return Scratch(items.sparkSession, "leaks").keep(made, "automata")


def _passes(made: DataFrame) -> Iterator[tuple[list, int]]:
    """For each pass over the documents: broadcasts of at most BLOCKS_AT_ONCE automata, and the words of the longest item."""
    context = made.sparkSession.sparkContext
    known = made.groupBy("block").agg(F.max("longest").alias("longest")).collect()
    overlap = max((row["longest"] for row in known), default=0)
    numbers = sorted(row["block"] for row in known)
    for low in range(0, max(1, len(numbers)), BLOCKS_AT_ONCE):
        shared = []
        for number in numbers[low : low + BLOCKS_AT_ONCE]:
            rows = made.where(F.col("block") == number).orderBy("part").collect()
            shared.append(context.broadcast(b"".join(bytes(row["body"]) for row in rows)))
        yield shared, overlap


def _load(shared: list) -> list[Automaton]:
    return [Automaton.load(memoryview(one.value)) for one in shared]


def _laid_out(lists: list[list[str]], overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes of all texts; start, text and first word of each stretch. Long texts are cut into stretches that overlap."""
    flat = word_codes([w for words in lists for w in words])
    base, pieces, starts, owner, offset = 0, [], [], [], []
    place = 0
    step = max(STRETCH_WORDS, overlap)
    for n, words in enumerate(lists):
        for low in range(0, max(1, len(words)), step):
            begin = max(0, low - overlap)
            end = min(len(words), low + step)
            pieces.append(flat[base + begin : base + end])
            starts.append(place)
            owner.append(n)
            offset.append(begin)
            place += end - begin
        base += len(words)
    codes = np.concatenate(pieces) if pieces else np.zeros(0, "u8")
    return codes, np.array(starts, "i8"), np.array(owner, "i8"), np.array(offset, "i8")


def _found(automata: list[Automaton], lists: list[list[str]], overlap: int, least_words: int):
    """For each automaton: (text, index of the last word, length, state) of the matches."""
    codes, starts, owner, offset = _laid_out(lists, overlap)
    for automaton in automata:
        place, size, state = automaton.stream(codes, starts, least_words)
        stretch = np.searchsorted(starts, place, "right") - 1
        yield automaton, owner[stretch], place - starts[stretch] + offset[stretch], size, state


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least_words: int = 12,
) -> DataFrame:
    """doc_id, item_id, longest: which items stand in which documents, and the longest match.

    longest: words of the longest match that ends on words of the item.
    """
    if least_words < 1:
        raise ValueError("least_words must be positive")
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, item_id bigint, longest int"
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = None
    for shared, overlap in _passes(_blocks(items, item_id, item_text, least_words)):

        def scan(batches: Iterator[pd.DataFrame], shared=shared, overlap=overlap) -> Iterator[pd.DataFrame]:
            automata = _load(shared)
            for batch in batches:
                numbers, rows = batch["doc_id"].to_numpy(), []
                for automaton, doc, _, size, state in _found(automata, [words_of(t) for t in batch["text"]], overlap, least_words):
                    # One entry per document and state, with its longest match.
                    order = np.lexsort((-size, state, doc))
                    doc, size, state = doc[order], size[order], state[order]
                    head = np.ones(len(doc), bool)
                    head[1:] = (doc[1:] != doc[:-1]) | (state[1:] != state[:-1])
                    for d, s, length in zip(doc[head].tolist(), state[head].tolist(), size[head].tolist()):
                        low, count = automaton.first[s].tolist()
                        rows += [(numbers[d], item, length) for item in automaton.items[low : low + count].tolist()]
                frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "longest"])
                yield frame.groupby(["doc_id", "item_id"], as_index=False)["longest"].max() if rows else frame

        leaks = docs.mapInPandas(scan, schema)
        found = leaks if found is None else found.unionByName(leaks)
    return found.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"))


def remove_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least_words: int = 12,
    most_coverage: float = 0.5,
) -> DataFrame:
    """doc_id, clean_text, coverage: documents with the leaked spans cut out.

    coverage: share of the document's words in leaked spans. A document above
    ``most_coverage`` is left out; one without leaks keeps its text as it is.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    out = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("clean_text"), F.lit(0.0).alias("coverage"))
    for shared, overlap in _passes(_blocks(items, item_id, item_text, least_words)):

        def scan(batches: Iterator[pd.DataFrame], shared=shared, overlap=overlap) -> Iterator[pd.DataFrame]:
            automata = _load(shared)
            for batch in batches:
                plain = [even(body) if body else "" for body in batch["clean_text"]]
                spots = [list(_WORD.finditer(p)) for p in plain]
                marked = [np.zeros(len(one) + 1, "i4") for one in spots]
                for _, doc, last, size, _ in _found(automata, [[m.group() for m in one] for one in spots], overlap, least_words):
                    for d, n, length in zip(doc.tolist(), last.tolist(), size.tolist()):
                        marked[d][n - length + 1] += 1
                        marked[d][n + 1] -= 1
                rows = []
                for number, body, covered, even_text, places, marks in zip(
                    batch["doc_id"], batch["clean_text"], batch["coverage"], plain, spots, marked
                ):
                    hits = np.cumsum(marks[:-1]) > 0
                    if not hits.any():
                        rows.append((number, body, covered))
                        continue
                    keep, at = [], 0
                    for spot, hit in zip(places, hits.tolist()):
                        if hit:
                            keep.append(even_text[at : spot.start()] if not keep or at < spot.start() else "")
                            at = spot.end()
                    keep.append(even_text[at:])
                    rows.append((number, re.sub(r"\s+", " ", "".join(keep)).strip(), max(covered, float(hits.mean()))))
                yield pd.DataFrame(rows, columns=["doc_id", "clean_text", "coverage"])

        out = out.mapInPandas(scan, f"doc_id {kind}, clean_text string, coverage double")
    return out.where(F.col("coverage") <= most_coverage)

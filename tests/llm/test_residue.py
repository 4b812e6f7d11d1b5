import random

import numpy as np
import pytest
from conftest import rows_of

from lumenfold.llm import residue
from lumenfold.llm.residue import Judge, exclude_residue, find_residue, prose_counts, views

DOCS = "doc_id bigint, text string, kinds string"
PROSE = [
    "We walked along the old pier before the rain came, and the kids had lunch by the river.",
    "The light was soft and the card was almost full, so I switched to the wide lens.",
    "My brother filmed the last bridge on the way home, which is why the clip is short.",
    "A second pass fills in missing places. Keep raw files and previews in one folder.",
]
RESIDUE = {
    "Welcome to {{place}}! We had a good time by the lake and the old mill.": "slot",
    "Dear <%= name %>, here are the pictures from the summer by the sea.": "slot",
    "This album holds undefined pictures of the harbour in winter.": "slot",
    "Filmed on [INSERT DATE HERE] near the lighthouse steps.": "slot",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod.": "filler",
    "Your text goes here. Replace this with your own words.": "filler",
    "404 Not Found": "notice",
    "Some caption.\n\nPlease enable JavaScript to view this gallery.": "notice",
    "SEITE NICHT GEFUNDEN. FEHLER 404.": "notice",
    "Access denied. You do not have permission to view this page.": "notice",
}
#: Wordings that stand in no example of the models.
HELD_OUT = {
    "This site needs cookies and JavaScript. Turn them on and reload.": "notice",
    "Your session timed out. Please sign in again.": "notice",
    "Diese Seite benötigt JavaScript. Bitte aktivieren Sie es in Ihrem Browser.": "notice",
    "Le serveur a rencontré une erreur interne. Veuillez réessayer plus tard.": "notice",
    "No se encontró la página. Error 404.": "notice",
    "An internal error occurred on the server. Please try again later.": "notice",
    "Gateway timeout: the upstream server did not respond.": "notice",
    "Your browser does not support this page. Please update it.": "notice",
    "Curabitur nec sapien eget nisl facilisis dictum vel ut mauris integer blandit.": "filler",
    "Put your own words here.": "filler",
    "Dies ist ein Platzhaltertext.": "filler",
    "Ceci est un texte de remplissage.": "filler",
    "Hi ${user.name}, welcome back to the lake.": "slot",
    "Photo {0} of {1} at the pier": "slot",
    "Dear {first name}, we had lunch by the river.": "slot",
    "By %%NAME%% at the mill": "slot",
    "By #name# at the mill": "slot",
    "The ##title## of the walk": "slot",
    "Seen by %s at the river": "slot",
    "Meet at [location goes here] at noon.": "slot",
    "Filmed with (lens TBD) near the lake.": "slot",
    "Title: {camera}": "slot",
}
TALK = [
    "In the template the token {{place}} stands for the town, and the export filled it everywhere.",
    "A screen said access denied, which the kids found very funny.",
    "The folder pattern {year}/{month}/{camera} files photos by month.",
    "Set the root with export PHOTOS=$HOME/photos and the scan finds the card.",
    "2020-01-01T10:00:00 ERROR IMG_1234.JPG: access denied at byte 12",
    "The sign read ERROR in red letters for the whole ride.",
    "The server was down for maintenance on Tuesday, but the upload went through.",
    "The regex was \\d{4} and the date was set with %d/%m/%Y in the menu.",
    "The guide said page not found, and we laughed.",
    "We knew something went wrong with the battery.",
    "Файлы лежат в папке, и всё хорошо.",
    "In our layout the variable ${city} is replaced by the town during export.",
    "He told us that the site asked him to enable JavaScript, so we took the paper map.",
    "The 404 bus to the harbour left at noon, and it rained on Monday with 50 % of the day left.",
]


def prose(count):
    return [(n, f"{PROSE[n % 4]} {PROSE[(n * 7 + 1) % 4]}", "x") for n in range(count)]


def corpus():
    bad = [(1000 + n, t, "x") for n, t in enumerate(RESIDUE)]
    talk = [(2000 + n, t, "x") for n, t in enumerate(TALK)]
    return prose(300) + bad + talk + [(3000, None, "x"), (3001, "", "x"), (3002, "abc", "x"), (3003, PROSE[0] * 4000 + list(RESIDUE)[0], "x")]


def test_finds_residue_and_not_talk(spark):
    found = {d: k for d, k in rows_of(find_residue(spark.createDataFrame(corpus() + corpus()[-1:], DOCS)).selectExpr("doc_id", "kinds[0]"))}
    assert set(found) == {1000 + n for n in range(len(RESIDUE))} | {3003}
    for n, kind in enumerate(RESIDUE.values()):
        assert found[1000 + n] == kind


def test_held_out_wordings(spark):
    known = "\n".join((*residue.FILLER_EXAMPLES, *residue.LATIN_EXAMPLES, *residue.NOTICE_EXAMPLES))
    assert not any(text.casefold() in known for text in HELD_OUT)
    rows = prose(400) + [(1000 + n, t, "x") for n, t in enumerate(HELD_OUT)] + [(2000 + n, t, "x") for n, t in enumerate(TALK)]
    found = {d: k.split() for d, k in rows_of(find_residue(spark.createDataFrame(rows, DOCS)).selectExpr("doc_id", "array_join(kinds, ' ')"))}
    assert set(found) == {1000 + n for n in range(len(HELD_OUT))}
    for n, kind in enumerate(HELD_OUT.values()):
        assert kind in found[1000 + n]


@pytest.mark.parametrize("kind", ["filler", "notice", "latin", "shapes", "slot", "mention"])
def test_rows_come_from_the_models(kind):
    """Without a model's ratios its texts are lost, or its mentions come out."""
    judge, texts = Judge(), [*RESIDUE, *HELD_OUT, *TALK]
    before = [bool(judge.judge(t)) for t in texts]
    if kind in judge.words:
        judge.words[kind] = np.full_like(judge.words[kind], -1)
    else:
        setattr(judge, kind, np.full_like(getattr(judge, kind), -1))
    assert [bool(judge.judge(t)) for t in texts] != before


def test_exclusion_by_coverage(spark):
    frame = spark.createDataFrame(corpus(), DOCS)
    left = {d for (d,) in rows_of(exclude_residue(frame, least_coverage=0.5), "doc_id")}
    assert 1000 in left and 3003 in left and 1006 not in left and {3000, 3001} <= left
    assert {d for (d,) in rows_of(exclude_residue(frame), "doc_id")} & set(range(1000, 2000)) == set()


def test_empty(spark):
    assert find_residue(spark.createDataFrame([], DOCS)).count() == 0


def test_windows_localise():
    text = PROSE[0] + " Lorem ipsum dolor sit amet. " + PROSE[1] + " Dear {{name}}, hello. " + PROSE[2]
    spans = Judge().judge(text)
    assert {kind for kind, _, _ in spans} == {"filler", "slot"}
    assert any("ipsum" in text[a:b] for _, a, b in spans) and any("{{name}}" in text[a:b] for _, a, b in spans)
    assert sum(b - a for _, a, b in spans) < len(text) / 3
    assert not any(Judge().judge(t) for t in [*PROSE, "", "abc"])


def test_repeated_residue_is_found(spark):
    repeated = ["{{name}} visited {{place}} on {{date}}", "404 Not Found", "Your session has expired. Log in again.", "Lorem ipsum dolor sit amet"]
    repeated += ["Hi $name$, the lake was calm today", "Dear @@d@@ and all of the family", "Text to be added."]
    for text in repeated:
        rows = prose(400) + [(1000 + n, text, "x") for n in range(200)] + [(5000 + n, t, "x") for n, t in enumerate(TALK * 20)]
        found = {d for (d,) in rows_of(find_residue(spark.createDataFrame(rows, DOCS)), "doc_id")}
        assert found == set(range(1000, 1200)), text


def test_counts_are_those_of_one_pass(spark):
    """The distributed counts equal counts in plain Python, however the texts are cut into partitions."""
    rows = corpus()
    got = prose_counts(spark.createDataFrame(rows, DOCS).repartition(5), "text")
    want = [np.zeros(view.size) for view in views()]
    for _, text, _ in rows:
        for part in residue._stretches(text or ""):
            *ids, a, b, c = Judge().read([part])[2]
            for sums, one, out in zip(want, ids, (a, b, c)):
                np.add.at(sums, one[~out], 1)
    for one, two in zip(got, want):
        assert (one[1:] == two[1:]).all()


def test_long_texts_are_cut_at_sentences(monkeypatch):
    monkeypatch.setattr(residue, "PIECE", 400)
    rng = random.Random(4)
    text = " ".join(rng.choice(PROSE) for _ in range(40))
    parts = list(residue._stretches(text))
    assert "".join(parts) == text and all(len(p) <= 400 for p in parts) and all(p.endswith(". ") or p.endswith(".") for p in parts)
    assert list(residue._stretches("x" * 1000)) == ["x" * 400, "x" * 400, "x" * 200]
    numbers = [n for lot, _ in residue._pieces([text, None, "a"]) for n in lot]
    assert sorted(set(numbers)) == [0, 1, 2]

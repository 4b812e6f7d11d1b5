import random

import numpy as np
import pytest
from conftest import rows_of

from lumenfold.llm import mixing
from lumenfold.llm.mixing import encoder, mix_rates, mix_shares

DOCS = "doc_id bigint, text string, source string, max_repeats string"
TARGETS = "source string, target_share double, max_repeats int"
WORDS = {"diary": "walk lunch rain hill friend", "manual": "press menu select button camera", "radio": "over station copy wind north"}


def corpus(counts, seed=0):
    rng = random.Random(seed)
    out = []
    for source, count in counts.items():
        for _ in range(count):
            text = " ".join(rng.choice(WORDS[source].split()) for _ in range(rng.randrange(20, 60)))
            out.append((len(out), text, rng.choice([source, source.upper(), f" {source} "]), "x"))
    return out


def test_shares_and_caps(spark):
    docs = corpus({"diary": 600, "manual": 300, "radio": 60})
    docs += [(9001, None, "diary", "x"), (9002, "", "diary", "x"), (9003, "no source", None, "x"), (9004, "no target", "other", "x")]
    targets = [("diary", 0.5, 1), ("manual", 0.3, 2), ("radio", 0.15, 4), ("absent", 0.05, 2)]
    rates = mix_rates(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    caps = {"diary": 1, "manual": 2, "radio": 4}
    for key, rate, copies in rows_of(rates, "source_key", "rate", "copies"):
        assert 0 <= copies <= caps.get(key, 0) and 0 <= rate <= caps.get(key, 0)
    shares = {r["source"]: r for r in mix_shares(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)).collect()}
    assert shares["absent"]["reached_share"] == 0 and set(shares) == {"diary", "manual", "radio", "absent"}
    for source, goal in (("diary", 0.5), ("manual", 0.3), ("radio", 0.15)):
        assert abs(shares[source]["reached_share"] - goal / 0.95) < 0.02
    assert max(s["most_copies"] for s in shares.values()) > 1


def test_too_small_a_source_falls_short(spark):
    docs = corpus({"diary": 300, "radio": 5})
    targets = [("diary", 0.5, 1), ("radio", 0.5, 2)]
    total = 12_000
    shares = {r["source"]: r for r in mix_shares(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), total_tokens=total).collect()}
    assert shares["radio"]["most_copies"] == 2 and shares["radio"]["reached_share"] < 0.2


def test_empty(spark):
    none = mix_shares(spark.createDataFrame([], DOCS), spark.createDataFrame([("diary", 1.0, 1)], TARGETS))
    assert rows_of(none, "source", "mixed_tokens") == {("diary", 0)}


def test_tokens_round_trip():
    code = encoder(mixing.TOKENIZER)
    text = "It's 3 o'clock — café,  naïve\n\n<|endoftext|>"
    assert code.decode(code.encode_ordinary(text)) == text
    with pytest.raises(FileNotFoundError):
        encoder("/nowhere.tiktoken")


def modelled(docs, counts):
    code = encoder(mixing.TOKENIZER)
    samples = [mixing.features(code, d[1])[0] for d in docs]
    return code, mixing.DomainModel(samples, [d[2].strip().lower() for d in docs], counts)


def test_classifier_on_held_out_documents():
    docs = corpus({"diary": 80, "manual": 80, "radio": 80}, seed=3)
    random.Random(1).shuffle(docs)
    code, model = modelled(docs, {"diary": 80, "manual": 80, "radio": 80})
    assert model.accuracy > 0.95
    likely = model.posterior(mixing.features(code, "press menu select camera button press menu")[0])
    assert abs(likely.sum() - 1) < 1e-6 and model.domains[int(likely.argmax())] == "manual"


def test_classifier_knows_the_true_shares():
    docs = corpus({"diary": 80, "manual": 80}, seed=3)
    docs = docs + [(n, d[1], "manual" if d[2].strip().lower() == "diary" else "diary", "x") for n, d in enumerate(docs)]
    code, model = modelled(docs, {"diary": 9_000, "manual": 1_000})
    likely = model.posterior(mixing.features(code, "walk lunch rain hill friend")[0])
    assert 0.8 < likely[model.domains.index("diary")] < 0.97


def mislabelled():
    """Diary documents, a third of which are labelled manual."""
    docs = corpus({"diary": 900, "manual": 300, "radio": 100}, seed=5)
    return [(n, t, "manual" if s.strip().lower() == "diary" and n % 3 == 0 else s, x) for n, t, s, x in docs]


def test_expected_tokens_meet_the_targets(spark):
    """The label takes no part in the membership: documents labelled wrongly count where their text belongs."""
    targets = [("diary", 0.4, 2), ("manual", 0.4, 4), ("radio", 0.2, 6)]
    frame, aims = spark.createDataFrame(mislabelled(), DOCS), spark.createDataFrame(targets, TARGETS)
    fitted, started = ({r["source"]: r for r in mix_shares(frame, aims, rounds=n).collect()} for n in (20, 0))
    off = {n: sum(abs(shares[s]["expected_share"] - goal) for s, goal, _ in targets) for n, shares in (("fit", fitted), ("start", started))}
    assert off["fit"] < 0.05 < off["start"]
    for source, goal, _ in targets:
        assert abs(fitted[source]["reached_share"] - goal) < 0.05


def test_fit_is_the_nearest_point(spark):
    """The rates are those of least squares by plain iteration on the same memberships."""
    targets = [("diary", 0.4, 2), ("manual", 0.4, 4), ("radio", 0.2, 6)]
    rates, domains, accuracy = mixing._mix(spark.createDataFrame(mislabelled(), DOCS), spark.createDataFrame(targets, TARGETS), close_enough=1e-5)
    assert accuracy > 0.75 and domains == ["diary", "manual", "radio"]
    rows = rates.select("source_key", "tokens", "rate", "member").collect()
    member = np.array([r["member"] for r in rows], "f8")
    label = np.array([[r["source_key"] == d for d in domains] for r in rows], "f8")
    tokens = np.array([r["tokens"] for r in rows], "f8")
    cap = label @ np.array([2.0, 4.0, 6.0])
    share = np.array([0.4, 0.4, 0.2])
    both = np.hstack([member, label])
    size = tokens @ label
    reach = np.minimum(size * [2, 4, 6], (tokens * cap) @ member)
    total = (reach / share).min()
    goal = np.tile(share * total, 2)
    start = np.minimum(cap, label @ (share * total / size))
    moves, step = np.zeros(6), 0.5 / (tokens @ both**2).max()
    for _ in range(20_000):
        moves += step * (goal - (tokens * np.clip(start + both @ moves, 0, cap)) @ both)
    want = np.clip(start + both @ moves, 0, cap)
    got = np.array([r["rate"] for r in rows])
    assert np.abs((tokens * got) @ both - goal).max() / total < 0.005
    assert (tokens * (got - start) ** 2).sum() < 1.05 * (tokens * (want - start) ** 2).sum() + 1e-3 * total


def test_long_and_rare_targets_are_mixed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SAMPLE_TOKENS", 8)
    docs = corpus({"diary": 300, "manual": 20})
    docs += [(5000 + n, " ".join(WORDS["radio"].split() * 60), "radio", "x") for n in range(20)]
    docs += [(6000 + n, f"sand dune camel {n}", f"other_{n % 700}", "x") for n in range(1_200)]
    targets = [("diary", 0.4, 1), ("manual", 0.2, 4), ("radio", 0.4, 2)]
    shares = {r["source"]: r for r in mix_shares(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)).collect()}
    for source, goal, _ in targets:
        assert abs(shares[source]["reached_share"] - goal) < 0.05
        assert abs(shares[source]["expected_share"] - goal) < 0.08

"""Whole texts of some megabytes, in the functions that the workers run."""

import numpy as np
import pyarrow as pa

from stratagraph.llm import alignment, decontamination, mixing, nearcopies, repetition, simhash, substrings, toxicity

RNG = np.random.default_rng(9)
WORDS = [f"w{i}" for i in range(5000)]
HALF = " ".join(RNG.choice(WORDS, 100_000))
LONG = HALF + "\n" + HALF


def test_repetition_of_a_doubled_text():
    n, _, _, dup, repeated, covered, longest = repetition.measure(["short", LONG, None])[1]
    assert (n, dup, repeated, covered, longest) == (200_000, 1, 200_000, 200_000, 100_000)


def test_fingerprints():
    assert simhash.fingerprint(LONG, 3) == simhash.fingerprint(LONG.replace("\n", " "), 3)
    found = nearcopies.shingles(LONG, 5)
    assert 99_000 < len(found) <= 100_100 and len(nearcopies.fingerprint(found)) == nearcopies.BITS // 8


def test_scores():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    assert np.allclose(toxicity.scores([LONG, ""], model), 1 / (1 + np.exp(1)))
    assert mixing.Classifier(model, model).posteriors([LONG]).shape == (1, 3)


def test_passages():
    p = decontamination.passages([decontamination.numbered(LONG, {w: i for i, w in enumerate(WORDS)})], np.ones(5000, bool), True)
    assert len(p.text) == 200_000 // 32 - 1 and p.start[-1] + 64 == 200_000


def test_substrings_of_one_document_and_its_later_copy():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([LONG, "x" + LONG], pa.string())], names=["a", "b"])
    packs = [substrings.Pack(*(c[0].as_py() for c in p.columns[:3]), 16) for p in substrings._packed(iter([batch]))]
    (pack,) = packs
    assert len(pack.blocks) == 2
    later = pack.doc == 1
    assert sum(pack.count[~later]) == len(LONG) - 49
    assert sum(pack.leads[later]) <= 4  # but for the strings with the new first byte


def test_alignment_of_many_lines():
    a = RNG.integers(1, 10**9, 20_000).tolist()
    b = a[:5_000] + [7] + a[6_000:]
    assert len(alignment.aligned(a, b)) == 19_000

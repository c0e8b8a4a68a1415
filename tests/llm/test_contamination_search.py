"""What op4 leaves out early changes no match."""

import numpy as np

from repalign.llm import contamination as C


def items():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
    return rng, words, [(k, " ".join(rng.choice(words, n))) for k, n in enumerate((14, 20, 33, 60))]


def test_items_with_too_few_shared_grams_are_not_counted_in_bands(monkeypatch):
    rng, words, bench = items()
    index = C.build(bench, 0.1)
    text = C.plain_codes(" ".join(rng.choice(words, 30)))  # the vocabulary, but no item
    grams = C._grams(text)
    assert np.isin(grams, index.hashes).sum() > 20
    monkeypatch.setattr(C.np, "unique", None)
    assert C._bands(grams[:60], 0, index) == []


def test_alignments_of_mixed_lengths_equal_single_ones():
    rng, words, bench = items()
    index = C.build(bench, 0.1)
    jobs = []
    for k, codes in enumerate(index.codes):
        edited = codes.copy()
        edited[::25] = 120  # within the budget
        far = codes.copy()
        far[::3] = 120  # beyond it
        for version in (codes, edited, far):
            text = np.concatenate([C.plain_codes(" ".join(rng.choice(words, 5))) + 0, version, codes[:9]])
            start = len(text) - len(version) - 9
            jobs.append((codes, text, start - 2, int(index.edits[k])))
    allowed = [e for *_, e in jobs]
    single = [C._aligned([job])[0] for job in jobs]
    together = C._aligned(jobs)
    assert [x for x, e in zip(together, allowed) if x[0] <= e] == [x for x, e in zip(single, allowed) if x[0] <= e]
    assert [x[0] <= e for x, e in zip(together, allowed)] == [True, True, False] * 4

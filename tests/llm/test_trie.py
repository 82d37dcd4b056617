"""The trie of phrases stays small and quick to build with many words and large fans."""

import collections

import numpy as np

from ledgerflow.llm import phrases


def test_double_array_is_about_as_long_as_its_states():
    rng = np.random.default_rng(5)
    draw = lambda n, k: np.unique(np.minimum(rng.zipf(1.2, (n, k)), 15_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), axis=0)
    parts = [draw(40_000, 2), draw(8_000, 3), draw(2_000, 5)]
    trie = phrases.double_array(parts)
    assert len(trie.check) < 1.5 * (trie.check >= 0).sum()
    text = rng.permutation(np.concatenate([p.ravel() for p in parts] + [rng.integers(0, 99, 5_000).astype(np.uint64)]))
    names = {tuple(r): i for i, r in enumerate(r for p in parts for r in p.tolist())}
    want = collections.Counter(names.get(tuple(text[i : i + k].tolist()), -1) for k in (2, 3, 5) for i in range(len(text) - k + 1))
    got = trie.counts(text)
    assert {int(trie.row[s]): int(got[s]) for s in np.flatnonzero(got) if trie.row[s] >= 0} == {i: n for i, n in want.items() if i >= 0}


def test_double_array_of_few_words():
    for words in (1, 2, 3, 4, 15, 16, 17):
        for k in (2, 3):
            every = np.stack(np.meshgrid(*[np.arange(1, words + 1, dtype=np.uint64)] * k), -1).reshape(-1, k)
            trie = phrases.double_array([every])
            text = np.concatenate([every[::-1].ravel(), [0, 99, 1]]).astype(np.uint64)
            got = trie.counts(text)
            want = collections.Counter(tuple(text[i : i + k].tolist()) for i in range(len(text) - k + 1))
            assert [int(got[np.flatnonzero(trie.row == i)[0]]) for i in range(len(every))] == [want[tuple(r)] for r in every.tolist()]

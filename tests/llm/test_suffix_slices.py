"""A shard's slices: only those whose strings may repeat are sorted, and they lose what a plain comparison of strings says."""

import numpy as np
import pytest

from motionframe.llm import suffix


def _shard(repeats):
    """``data, start, size, first`` of 400 slices of random letters, of which the first ``repeats`` pairs share a passage."""
    rng = np.random.default_rng(repeats)
    size = rng.integers(1, 28, 400)
    parts = [rng.integers(97, 123, s + 49).astype(np.uint8) for s in size]
    for i in range(repeats):
        parts[2 * i][-50:] = parts[2 * i + 1][:50]
    length = size + 49
    return np.concatenate(parts), np.cumsum(length) - length, size, rng.integers(0, 50, 400).astype(np.int64)


@pytest.mark.parametrize("repeats", [0, 1, 50])
def test_only_slices_that_may_repeat_are_sorted(monkeypatch, repeats):
    data, start, size, first = _shard(repeats)
    some = suffix._may_repeat(suffix.Hashes(data), start, size, 50)
    assert some.tolist() == list(range(2 * repeats))
    sorted_, plain = [0], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda t: sorted_.append(len(t)) or plain(t))
    seen = {}
    for s, n, f in zip(start, size, first):
        for i in range(n):
            string = data[s + i : s + i + 50].tobytes()
            seen[string] = min(seen.get(string, f), f)
    expected = np.array([sum((seen[data[s + i : s + i + 50].tobytes()] < f) << i for i in range(n)) for s, n, f in zip(start, size, first)], np.uint32)
    found = np.zeros(len(size), np.uint32)
    if len(some):
        found[some] = suffix._earlier(data, start[some], size[some], first[some], 50, np.uint32)
    assert (found == expected).all() and (repeats < 2 or expected.any())
    assert sum(sorted_) < 0.4 * len(data)

"""The run-length index against a dictionary of all 50-byte strings."""
import numpy as np
import pytest

from tidegauge.llm.suffix_dedup import LENGTH, RunIndex


@pytest.mark.parametrize("letters", [1, 2, 4, 256])
def test_first_documents(letters):
    rng = np.random.default_rng(letters)
    parts = [rng.integers(0, letters, n, np.uint8).tobytes() for n in (30, 45, 55, 60)]
    strings = [b"".join(parts[i] for i in rng.integers(0, len(parts), 3)) for _ in range(12)]
    strings += [strings[0], bytes(range(256)), strings[3][:LENGTH], strings[5][7:7 + LENGTH]]
    docs = np.sort(rng.integers(0, 9, len(strings)))
    holders = {}
    for s, d in zip(strings, docs.tolist()):
        for i in range(len(s) - LENGTH + 1):
            holders.setdefault(s[i:i + LENGTH], []).append(d)
    index = RunIndex(strings, np.array([len(s) for s in strings]), docs)
    got = index.first_documents()
    for s, start in zip(strings, index.starts.tolist()):
        for i in range(len(s)):
            held = holders.get(s[i:i + LENGTH], []) if i + LENGTH <= len(s) else []
            assert got[start + i] == (min(held) if len(held) > 1 else -1)

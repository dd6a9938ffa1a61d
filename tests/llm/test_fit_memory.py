"""The driver's memory while the language model is fitted."""

import tracemalloc

import numpy as np

from cloakframe.llm import language_id


def made(words: int) -> tuple[list[str], list[str]]:
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{lang}{i % 40}" for i in rng.integers(0, 1000, words // 20)) for lang in ("ab", "cd") for _ in range(10)]
    return texts, ["x"] * 10 + ["y"] * 10


def test_memory_of_a_fit_does_not_hold_all_passes():
    texts, langs = made(400_000)
    tracemalloc.start()
    try:
        language_id.fit(texts, langs, rounds=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6, peak


def test_blocks_of_sequences_sum_to_the_whole(monkeypatch):
    texts, langs = made(20_000)
    whole = language_id.fit(texts, langs, rounds=4)
    monkeypatch.setattr(language_id, "AT_ONCE", 7)
    parts = language_id.fit(texts, langs, rounds=4)
    assert np.allclose(whole.weights, parts.weights, atol=1e-5) and np.allclose(whole.transitions, parts.transitions, atol=1e-9)

"""The tokenizer's memory of pieces may start anew at any time, even within a text of more pieces than it keeps."""

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from wordmill.llm import tokens  # noqa: E402


def test_ids_do_not_depend_on_the_memory(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    bpe, rng = tokens.WordBpe(public_tokenizers.path("word_bpe_49k.json")), np.random.default_rng(2)
    assert "exact" not in bpe.__dict__  # loaded for the first text that needs it
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    known = [word() for _ in range(30)]
    texts = [" ".join(known), " ".join([*known, *(word() for _ in range(90))]), " ".join(known[:5]), None, "", " ".join(known)]
    for text in texts:
        got = np.concatenate([ids for _, _, ids, _ in bpe.encode(pa.array([text], pa.string()))])
        assert got.tolist() == bpe.exact.encode(text or "", add_special_tokens=False).ids

"""What a Python worker holds at once, and what it keeps for the stages after."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from larder.llm import pieces, toxicity

TEXTS = ["plain words stand here", "other words, and plain ones", None, ""] * 3


def test_a_task_with_a_memory_of_its_own_forgets_it():
    batch = pa.record_batch([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS, pa.string())], names=["doc_id", "text"])
    model = pieces.pieces(public_tokenizers.path(pieces.MODEL))
    model.forget()
    kept = list(pieces._digests(iter([batch]), None, False, None))
    assert model.known
    assert list(pieces._digests(iter([batch]), None, False, 1_000)) == kept
    assert not model.known and not model.older


@pytest.mark.parametrize("bound", [1, 40, 1_000_000])
def test_counts_of_terms_come_in_bounded_parts_that_add_up(monkeypatch, bound):
    monkeypatch.setattr(toxicity, "COUNTED", bound)
    labels = [i % 2 for i in range(len(TEXTS))]
    rows = pa.record_batch([pa.array(TEXTS, pa.string()), pa.array(labels, pa.int32())], names=["text", "toxic"])
    parts = list(toxicity._counted(iter([rows])))
    most = max(len(toxicity._terms(toxicity.fold(t)[0])) for t in TEXTS)
    assert max(len(p) for p in parts) <= bound + most
    sums = Counter()
    for part in parts:
        for row in part.to_pylist():
            sums.update({(row["term"], 1): row["toxic"], (row["term"], 0): row["clean"]})
    expected = Counter((term, y) for t, y in zip(TEXTS, labels, strict=True) for term in toxicity._terms(toxicity.fold(t)[0]))
    assert +sums == expected


def test_texts_are_held_a_few_at_a_time():
    rows = pa.record_batch([pa.array(range(2_000), pa.int64()), pa.array(["calm"] * 2_000, pa.string())], names=["doc_id", "text"])
    parts = list(toxicity._scored(iter([rows]), toxicity.Lexicon(())))
    assert max(len(p) for p in parts) <= 512 and sum(len(p) for p in parts) == 2_000

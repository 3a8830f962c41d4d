"""Properties that hold for any input, without Spark."""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from sigloom.llm import abuse, bpe, frequent, packing  # noqa: E402
from sigloom.llm.spelling import folded, plain  # noqa: E402

TOKENS = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"ca", b"aa", b"aaa", b"aaaa", b"abca", b"cab", b" a", b" ab"]
SMALL = bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(TOKENS)))


def merge_by_rank(data: bytes) -> list[int]:
    parts = [bytes([b]) for b in data]
    while True:
        best = min(((SMALL.ids[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in SMALL.ids), default=None)
        if best is None:
            return [SMALL.ids[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc ", max_size=40))
def test_backtracking_equals_merging_by_rank(text):
    assert SMALL.encode_bytes(text.encode()) == merge_by_rank(text.encode())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=60))
def test_ascii_texts_split_alike(text):
    assert SMALL.split_ascii(text) == SMALL.split(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(text):
    ids = np.array(SMALL.encode(text), dtype=np.int64)
    data, ends = SMALL.decode_rows(ids, np.array([len(ids)]))
    assert data.tobytes() == text.encode("utf-8", "replace") and ends[-1] == len(data)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.sampled_from("abcdefghij")), max_size=40), max_size=6), st.integers(1, 6))
def test_bounds_of_any_merged_summary(parts, counters):
    summaries = [b for p in parts for b in frequent.summarise(iter([pa.record_batch({"x": pa.array(p, pa.string())})]), counters, chunk=7)]
    out = next(frequent.merge_summaries(iter(summaries), counters, chunk=5)).to_pylist()
    truth = Counter(x for p in parts for x in p if x is not None)
    n = sum(truth.values())
    kept = {r["item"]: r["counter"] for r in out[:-1]}
    slack = (n - sum(kept.values())) / (counters + 1)
    assert out[-1]["n_items"] == n and len(kept) <= counters
    assert all(truth[x] - slack <= kept.get(x, 0) <= truth[x] for x in truth)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), max_size=60), st.integers(1, 8))
def test_any_packing_keeps_the_limits(items, segments):
    limits = packing.Limits(50, segments, 40)
    n = np.array([t for t, _ in items], dtype=np.int64)
    loss = np.minimum(np.array([x for _, x in items], dtype=np.int64), np.minimum(n, 40))
    container, position = packing.fill(n, loss, limits)
    assert (container >= 0).all()
    for c in set(container.tolist()):
        inside = container == c
        assert n[inside].sum() <= 50 and inside.sum() <= segments and loss[inside].sum() <= 40
        assert sorted(position[inside].tolist()) == list(range(int(inside.sum())))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.integers(0, 300), st.integers(1, 60), st.integers(1, 60))
def test_pieces_cover_an_item_once(n, prompt, tokens, loss):
    prompt = min(n, prompt)
    limits = packing.Limits(tokens, 4, loss)
    cut = packing.pieces(n, prompt, limits)
    assert sum(p[1] for p in cut) == n and sum(p[2] for p in cut) == n - prompt
    assert all(p[1] <= tokens and p[2] <= loss for p in cut)
    assert [p[0] for p in cut] == [sum(q[1] for q in cut[:i]) for i in range(len(cut))]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_has_a_score(text):
    value, kind, hits = abuse.grammar().document(text)
    assert 0 <= value <= 1 and hits >= 0 and kind in ("", "abusive", "hateful", "sexual")
    assert folded(folded(text)) == folded(text) and isinstance(plain(text), str)

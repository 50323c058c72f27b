"""The vectorised text kernel against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import kernel as K
from tessera.llm.rules import count_block

texts = st.lists(st.one_of(st.none(), st.text(alphabet=" ab\n\té#€Z\u2003", max_size=40)), min_size=1, max_size=6)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_and_hashes(rows):
    seen = {}
    got = []
    for block in K.blocks(pa.array(rows, pa.string()), 32):
        b, e, of = block.runs(K.NOT_SPACE)
        raw = block.data.tobytes()
        for x, y, i, h in zip(b, e, of, block.hashes(b, e), strict=True):
            assert seen.setdefault(int(h), raw[x:y]) == raw[x:y]
            got.append((block.first + int(i), raw[x:y].decode()))
    assert got == [(i, w) for i, t in enumerate(rows) for w in WORD.findall(t or "")]


@settings(max_examples=60, deadline=None)
@given(texts)
def test_rule_counts(rows):
    block = next(K.blocks(pa.array(rows, pa.string()), 1 << 20))
    got = count_block(block)
    for i, t in enumerate(rows):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        hit = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_block_edges():
    assert list(K.blocks(pa.array([], pa.string()))) == []
    sliced = pa.array(["xx", "a b", None, "c"]).slice(1)
    block = next(K.blocks(sliced))
    assert block.n == 3 and block.data.tobytes() == b"a bc" and np.diff(block.starts).tolist() == [3, 0, 1]


def test_hashes_of_long_texts_by_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    begins = np.sort(rng.integers(0, 4900, 400))
    ends = begins + rng.integers(0, 90, 400)
    begins, ends = np.append(begins, 4950), np.append(ends, 5000)
    begins[0], ends[0] = 0, 4000  # longer than a piece
    whole = K.Block(data, np.array([0, 5000])).hashes(begins, ends)
    monkeypatch.setattr(K, "SUM_BYTES", 300)
    assert (K.Block(data, np.array([0, 5000])).hashes(begins, ends) == whole).all()
    for i in range(0, 400, 40):
        assert K.Block(data[begins[i] : ends[i]], np.array([0, ends[i] - begins[i]]))._whole()[0] == whole[i]

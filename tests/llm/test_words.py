import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabveil.llm import words as W


@given(st.lists(st.text(alphabet="ab \n\té\x0b", max_size=30), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_split(texts):
    raw = [t.encode() for t in texts]
    w = W.Words(raw)
    assert [w.word(i) for i in range(len(w))] == [x for t in raw for x in t.split()]
    assert w.n.tolist() == [len(t.split()) for t in raw]
    seen = {}
    for i, h in enumerate(w.hashes().tolist()):
        assert seen.setdefault(w.word(i), h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows():
    h = W.mix(np.array([1, 2, 3, 1, 2, 3, 9], np.uint64))
    x = W.windows(h, 3)
    assert x[0] == x[3] and len(set(x.tolist())) == 4 and len(W.windows(h, 8)) == 0

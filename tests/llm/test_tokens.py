import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from crateline.llm import tokens

PATH = tokens.vocabulary()


class Counted:
    """The library's tokenizer, and how often it is called."""

    def __init__(self, own):
        self.own, self.calls = own, 0

    def __getattr__(self, name):
        self.calls += name.startswith("encode") and name != "encode_special_tokens"
        return getattr(self.own, name)


def told(coder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in coder.code(texts)]


def test_new_segments_are_coded_many_at_a_call():
    pick = random.Random(5)
    made = lambda: "".join(pick.choice("abcdeéüß'.,-7") for _ in range(pick.randint(2, 30)))
    texts = [" ".join(made() for _ in range(400)) for _ in range(40)]
    coder = tokens.Coder(PATH)
    wanted = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    coder.tokenizer = Counted(coder.tokenizer)
    assert told(coder, texts) == wanted
    assert coder.tokenizer.calls < 200  # 16,000 segments, most of them new; first and last ones of a text alone
    coder.tokenizer.calls = 0
    assert told(coder, texts[::-1]) == wanted[::-1]


def test_a_full_table_keeps_what_is_used_most():
    table, ids = tokens.Segments(64), np.arange(64, dtype=np.uint32)
    words = np.stack([np.arange(1, 201, dtype=np.uint64)] * 4, axis=1)
    add = lambda a, b: table.add(words[a:b], tokens._key(words[a:b]), ids[:b - a], np.ones(b - a, np.int64))
    find = lambda a, b: table.find(words[a:b], tokens._key(words[a:b]))
    add(0, 60)
    for at in range(60, 200, 10):  # eight are used in every call, all others are new
        assert (find(4, 12) >= 0).all() and (find(at, at + 10) < 0).all()
        add(at, at + 10)
    assert table.pool[table.at[find(4, 12)]].tolist() == list(range(4, 12)) and (find(0, 4) < 0).all() and (find(190, 200) >= 0).all()


CODER = tokens.Coder(PATH)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.sampled_from("ab éß日̀\u0085\xa0\n\t\r'sx1.,!<|>\0"), max_size=40), max_size=6))
def test_strung_segments_have_the_library_s_ids(texts):
    new = tokens.Coder.__new__(tokens.Coder)
    new.__dict__ |= CODER.__dict__ | {"segments": tokens.Segments(64)}
    for coder in (CODER, new):
        assert told(coder, texts) == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

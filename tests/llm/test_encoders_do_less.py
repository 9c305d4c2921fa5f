"""Only the stretches that can matter are searched, and each different piece of a call is looked up once."""

import math

import numpy as np
import public_tokenizers

from dunlin.llm import pieces_nbest, token_file


def test_search_stops_at_enough_free_stretches(monkeypatch):
    tool = pieces_nbest.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    words = "these international regulations unquestionably misrepresent the counterintuitive xqzjv zzkwv ab".split()
    loss = {w: tool.best("▁" + w)[2] for w in words}
    free = [w for w in words if loss[w] == 0]
    texts = [" ".join(words * 2), " ".join(reversed(words)), words[0], "", "   ", "é " * 70 + " ".join(words)]
    if free:
        texts.append(" ".join([free[0]] * 3 + words))
    for text in texts:
        parts = pieces_nbest._STRETCH.findall("▁" + text.replace(" ", "▁"))
        every = np.array([tool.best(x)[2] for x in parts])
        order = [k for k in np.argsort(every, kind="stable")[:3].tolist() if every[k] < math.inf]
        assert tool.nearest(parts, 3) == order
    asked = []
    fresh = pieces_nbest.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    real = fresh.best
    monkeypatch.setattr(fresh, "best", lambda s: asked.append(s) or real(s))
    assert free
    fresh.encode(" ".join([free[0]] * 3 + words))
    assert asked == ["▁" + free[0]]


def test_pieces_are_looked_up_once_for_each_call():
    e = token_file.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "a  b\n", "Don't STOP\tnow ", "x" * 60 + " ß é İ 12", "<|x|> a", "a b " * 500, "\n", "你好 a"]
    assert e.encode_all(texts) == [e.raw(x) for x in texts]
    asked = []

    class Memo(dict):
        def __getitem__(self, key):
            asked.append(key)
            return dict.__getitem__(self, key)
    e.pieces = Memo(e.pieces)
    e.encode_all(["a b " * 500])
    assert sorted(asked) == ["", "a", "b"]
    assert e.encode_all([]) == []

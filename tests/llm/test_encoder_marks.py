"""A word between marks is cut without the pattern, and as the library cuts it."""

import numpy as np
import public_tokenizers

from dunlin.llm.token_file import Encoder


def test_words_between_marks():
    e, asked = Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    find = e.find
    e.find = lambda x: asked.append(x) or find(x)
    easy = ["(Word),", "word.", "\"QUOTED\"", "__init__", "a-", "<b>", "zebra;;;"]
    hard = ["it's", "'sword", "sword'", "a-b", "x1", "...", "café,", "<|endoftext|>", "K.", "a\x1c", "''ve", "-'re", "(don't)"]
    texts = [*easy, *hard, " ".join(easy + hard)]
    for text, ids in zip(texts, e.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids, text
    assert not {x.lower() for x in easy} & set(asked)

"""A small corpus with everything that may go wrong in it, as tables in a folder."""

import datetime
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Extra columns whose names the operators use themselves.
CLASH = ["bucket", "token", "sid", "n", "row", "_row", "a", "term", "chunk", "grp", "ids", "_id", "spans", "rank"]


def sentence(rng, n, lang="en"):
    stems = {"en": ["the", "tion", "wh", "ing", "of", "ha"], "de": ["sch", "und", "der", "ß", "ung", "ä"]}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = []
    texts = [sentence(rng, rng.randint(3, 160), rng.choice(["en", "de"])) for _ in range(40)]
    passage = sentence(rng, 70)
    for i in range(6):
        texts.append(sentence(rng, 60) + " " + passage + "\n" + sentence(rng, 30))
    base = sentence(rng, 120).split()
    for i in range(5):
        near = list(base)
        near[10 * i + 3] = f"edit{i}"
        texts.append(" ".join(near))
    texts += [texts[3]] * 3 + ["", "   \n ", "...!", "É", "Straße ÄÖ", "one", "one", "a b", "A B", "x " * 300, "z" * 5000, sentence(rng, 9000), "<|endoftext|> it's \x1c\x85 ☃"]
    for k in range(20):
        texts.append(sentence(rng, 40) + (" idiot scum " if k % 2 else " calm words ") + sentence(rng, 20))
    ids = list(range(3, 3 + len(texts)))
    rng.shuffle(ids)
    for i, t in zip(ids, texts):
        rows.append((i, t, "de" if "sch" in t else "en", "src", len(t)))
    rows.append((rows[0][0],) + rows[0][1:])                 # a repeated row
    rows += [(1, None, "en", "src", None), (2, None, None, None, None), (None, "a lost text of no id", "en", None, 3)]
    return rows


def write(folder, docs):
    os.makedirs(folder, exist_ok=True)
    n = len(docs)
    cols = list(zip(*docs)) if docs else [[]] * 5
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    table = {c: pa.array(list(v), t) for c, v, t in zip(("doc_id", "text", "lang", "source", "n_chars"), cols, types)}
    pq.write_table(pa.table({**table, **{c: pa.array([7] * n, pa.int64()) for c in CLASH}}), f"{folder}/documents.parquet")
    toxic = [(d[0], i % 2, int("idiot" in (d[1] or ""))) for i, d in enumerate(docs)] + ([(None, 1, 1), (10 ** 6, None, None)] if docs else [])
    pq.write_table(pa.table({c: pa.array([r[i] for r in toxic], pa.int64()) for i, c in enumerate(("doc_id", "quality", "toxic"))}), f"{folder}/labels.parquet")
    words = next((d[1].split() for d in docs if d[1] and 60 < len(d[1].split()) < 200), [])
    items = [(1, " ".join(words[5:40])), (2, "A B"), (3, ""), (4, None), (5, " ".join(words[5:40])), (6, "nothing here stands in any document " * 3)] if docs else []
    pq.write_table(pa.table({"item_id": pa.array([i[0] for i in items], pa.int64()), "text": pa.array([i[1] for i in items], pa.string())}), f"{folder}/benchmark.parquet")
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(400)] if docs else []
    rows = list(enumerate(vectors))
    if docs:
        rows += [(400, vectors[0]), (401, vectors[0]), (401, vectors[0]), (402, None), (403, [0.0] * 16), (404, [None] + [1.0] * 15), (405, [float("nan")] + [1.0] * 15), (406, []), (450, [1.0, 2.0]), (451, [2.0, 1.0]), (None, vectors[5])]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "rank": pa.array([1] * len(rows), pa.int32()), "block": pa.array([1] * len(rows), pa.int64())}), f"{folder}/embeddings.parquet")
    talk = [(c, t, ("user", "assistant")[t % 2], f"turn {c} {t}.") for c in range(30) for t in range(4)] if docs else []
    pq.write_table(pa.table({n: pa.array([r[k] for r in talk], pa.int64() if k < 2 else pa.string()) for k, n in enumerate(("conv_id", "turn", "role", "text"))}), f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    docs = corpus()
    return write(str(tmp_path_factory.mktemp("odd")), docs), docs


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(str(tmp_path_factory.mktemp("empty")), [])

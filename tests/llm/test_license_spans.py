"""License spans against brute force over all places of all templates."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from dunlin.llm import license_spans as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def base(w):
    return sorted((i, label) for phrase, label in ls.PHRASES for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p)


def licensed_texts():
    rng = random.Random(6)
    out = [None, "", "...", "MIT License", "mit-license MIT LICENSE mit license", "general public license general public", "É mit é license", "Licensed under CC BY-NC 4.0.", "the license " * 4000]
    for label, text in ls.TEMPLATES:
        out += [text.upper(), "intro words here " + ", ".join(text.split()) + "\nand more", text.replace(" the ", " thine ", 1)]
    vocabulary = [w for _, t in ls.TEMPLATES for w in t.split()]
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            t = rng.choice([*(x.split() for _, x in ls.TEMPLATES), *(x.split() for x, _ in ls.PHRASES)])
            i = rng.randrange(len(t))
            parts += t[i:rng.randint(i, len(t))] + ["zzz"] * rng.randint(0, 2)
        out.append(" ".join(parts))
    return out


def test_op13(spark, odd, tmp_path):
    docs = [(i, t) for i, t in enumerate(licensed_texts())] + [(3, "MIT License"), (None, "Apache License")]
    pq.write_table(pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string()),
                             **{c: pa.array([1] * len(docs), pa.int64()) for c in ("places", "spans", "n_words", "score", "label")}}), f"{tmp_path}/documents.parquet")
    for folder, rows in ((str(tmp_path), docs), (odd[0], [(d[0], d[1]) for d in odd[1]])):
        want = []
        for i, t in rows:
            w = split(t)
            b = base(w)
            want.append((i, len(w), len(b), min((x for x, _ in b), default=None), max((x for x, _ in b), default=None), ",".join(sorted({x for _, x in b}))))
        got = ls.op13_license_spans(spark, folder).collect()
        assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
        for r in got:
            labels = r["labels"].split(",") if r["labels"] else []
            assert labels == sorted(set(labels)) and set(r["base_labels"].split(",")) - {""} <= set(labels) and 0 <= r["score"] <= 1
            assert (r["score"] == 1.0) or not r["base_labels"]


def test_every_template_is_found_whole_and_nearly_whole(spark):
    rows = []
    for k, (label, text) in enumerate(ls.TEMPLATES):
        t = text.split()
        rows += [(2 * k, "before it stands this " + text + " and after it"), (2 * k + 1, " ".join(t[:len(t) // 2] + ["new", "words"] + t[len(t) // 2 + (len(t) > 20):]))]
    got = {r["doc_id"]: r["spans"] for r in ls.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, text) in enumerate(ls.TEMPLATES):
        n = len(text.split())
        assert any(s["label"] == label and s["share"] == 1.0 and (s["start"], s["end"]) == (4, 4 + n) for s in got[2 * k]), label
        if n > 20:
            assert any(s["label"] == label and s["share"] >= ls.COVER for s in got[2 * k + 1]), label


def test_matching_statistics_and_places():
    tool, rng = ls.Automaton(), random.Random(7)
    joined = [" ".join(["", *t, ""]) for _, t in tool.templates]
    for text in [t for t in licensed_texts() if t and len(t) < 500][::3]:
        w = split(text)
        data = np.frombuffer(text.encode(), np.uint8)
        ids, first = tool.token_ids(data, np.array([0, len(data)]))
        assert [tool.words[i].decode() if i >= 0 else None for i in ids] == [x if x in tool.ids else None for x in w]
        got = {}
        for _, at, tokens in tool.stretches(ids, first):
            for i, length, v in tool.matches(tokens):
                got[at + i] = (length, v)
        want = set()
        for k, (_, t) in enumerate(tool.templates):
            for e in range(len(t)):
                for i in range(len(w)):
                    n = 0
                    while n <= min(i, e) and w[i - n] == t[e - n]:
                        n += 1
                    if n >= min(ls.LEAST, len(t)) and (e + 1 == len(t) or i + 1 == len(w) or w[i + 1] != t[e + 1]):
                        want.add((k, i - n + 1, i + 1, e - n + 1, e + 1))
        assert set(tool.scan([(at, tokens) for _, at, tokens in tool.stretches(ids, first)])[1]) == want
        for i in range(len(w)):
            length = 0
            while length <= i and any(" " + " ".join(w[i - length:i + 1]) + " " in x for x in joined):
                length += 1
            if length > 1:
                assert got[i][0] == length
                v = got[i][1]
                places = {(k, e) for k, (_, t) in enumerate(tool.templates) for e in range(length - 1, len(t)) if t[e - length + 1:e + 1] == w[i - length + 1:i + 1]}
                assert tool.states[v].ends == places


def test_a_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(ls, "PART", 64)
    tool = ls.Automaton()
    text = " ".join(t for t in licensed_texts() if t)[:40_000] + "w" * 500 + " mit license"
    data = np.frombuffer(text.encode(), np.uint8)
    parts, _ = tool.token_ids(data, np.array([0, len(data)]))
    monkeypatch.setattr(ls, "PART", 1 << 30)
    whole, _ = tool.token_ids(data, np.array([0, len(data)]))
    assert np.array_equal(parts, whole) and len(whole) == len(split(text))

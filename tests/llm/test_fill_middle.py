"""Fill-in-middle against plain slicing, and the way back."""

import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq

from dunlin.llm import fill_middle as fm


def expected(doc_id, text):
    t = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(2)
    out = [None, "", "<P>", "a<S>b", "<<MM>>", "<M", "P>", "é", "👍" * 7, "x" * 300_000, "ñ☃" * 150_000]
    return out + ["".join(rng.choice("aé☃👍<PSM>\n ") for _ in range(rng.randint(0, 90))) for _ in range(800)]


def test_op12(spark, odd, tmp_path):
    docs = [(i, t) for i, t in enumerate(texts())] + [(7, "again"), (7, "again"), (None, "no id")]
    pq.write_table(pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string()),
                             **{c: pa.array([1] * len(docs), pa.int64()) for c in ("n", "form", "raw", "output")}}), f"{tmp_path}/documents.parquet")
    for folder, rows in ((str(tmp_path), docs), (odd[0], [(d[0], d[1]) for d in odd[1]])):
        want = []
        for i, t in rows:
            n, form, a, m, out = expected(i, t)
            want.append((i, n, form, a, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        got = [tuple(r) for r in fm.op12_fill_middle(spark, folder).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert {"plain", "psm"} <= {w[2] for w in want}


def test_small_blocks_and_bytes_that_are_no_utf8(monkeypatch):
    monkeypatch.setattr(fm, "BLOCK", 5)
    rng = random.Random(3)
    for k in range(1500):
        raw = bytes(rng.choice([65, 0xC3, 0xA9, 0x80, 0xFF, 60, 80, 62]) for _ in range(rng.randint(0, 50)))
        n, form, a, m, out = fm.transform(raw, k)
        assert fm.restore(bytes(out), form) == raw
        assert n == sum(b & 0xC0 != 0x80 for b in raw)
        if form == "plain":
            assert out == raw

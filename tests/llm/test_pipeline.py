"""The pipeline's stages on a small table, each against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cloudloom.llm import queries, tokens

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order(spark, tmp_path):
    words = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am") for b in ("em", "sum", "or", "ta", "et", "con")]
    base = [" ".join(words[(i * 7 + k * (i % 5 + 1)) % len(words)] for k in range(80 + i)) for i in range(20)]
    rows = [(i, t, "la", f"src{i % 4}", len(t)) for i, t in enumerate(base)]
    edited = [t.split() for t in base[5:9]]
    for k, w in enumerate(edited):
        w[3 + k] = "changed"
    rows += [(100 + i, t.replace(" ", "  "), "la", "src0", 0) for i, t in enumerate(base[:5])] + [(200, "12 34", None, "src1", 5), (201, None, None, None, None)]
    rows += [(300 + i, " ".join(w), "la", "src2", 0) for i, w in enumerate(edited)] + [(400, "lorem " * 3000, "la", None, 0)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
        seen.append(docs)
    assert {r.doc_id for r in seen[0].collect()} == {r[0] for r in rows} - {200, 201}
    kept = {}
    for i, t, *_ in rows:
        if t and re.search("[a-z]", t):
            key = re.sub(r"\s", "", t)
            kept[key] = min(kept.get(key, (0, 0)), (-len(t), i)) if key in kept else (-len(t), i)
    assert {r.doc_id for r in seen[1].collect()} == {i for _, i in kept.values()}
    texts = {r.doc_id: r.text for r in seen[1].collect()}
    stay = set(texts) - dropped(texts)
    assert {r.doc_id for r in seen[2].collect()} == stay and 300 in set(texts) - stay
    taken = Counter(r.doc_id for r in seen[3].collect())
    assert taken == mixed(seen[2].collect())
    pieces = [p for p in seen[4].collect()]
    at = {}
    for p in pieces:
        assert 0 < p.length <= 2048 and p.offset + p.length <= 2048
        at.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in at.values():  # gapless from 0
        held.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(held, held[1:], strict=False)) and held[0][0] == 0
    enc = tokens.encoder(queries.tokenizer_path(), True)
    want = Counter()
    for i, n in taken.items():
        ids = np.append(enc.encode([texts[i]])[0], np.uint32(0))
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())] += n
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want  # each copy that mixing takes is packed whole
    assert max(taken.values()) > 1 or len(taken) == len(stay)


def dropped(texts):
    """All pairs of five-word shingle sets, and what a smaller id reaches."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in texts if find(i) != i}


def mixed(rows):
    """{doc_id: times} by the SQL of the mixture over the stage's own input."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r.doc_id, r.text, r.lang, r.source) for r in rows], columns=["doc_id", "text", "lang", "source"]))
    return Counter(r[0] for r in con.execute(f"select doc_id from ({queries.SQL['op8_mixing']})").fetchall())

"""What a worker holds while it cuts texts into pieces: an executor's workers share what its JVM leaves."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from cloudloom.llm import queries, tokens

pytest.importorskip("public_tokenizers")

CHILD = """
import sys, threading, time
from unittest import mock
import pyarrow as pa
from cloudloom.llm import packing, queries

class Docs:
    select = lambda self, *columns: self
    mapInArrow = lambda self, f, schema: f

def held():
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) >> 10

def watch():
    while True:
        peak[0] = max(peak[0], held())
        time.sleep(0.005)

with mock.patch.object(packing, "F", mock.MagicMock()):
    run = packing.pieces(Docs(), queries.tokenizer_path(), added=True)
list(run(iter([pa.record_batch([pa.array([1]), pa.array(["a word"])], names=["doc_id", "text"])])))
first = held()
peak = [first]
threading.Thread(target=watch, daemon=True).start()
with pa.OSFile(sys.argv[1]) as f:
    rows = sum(b.num_rows for b in run(iter(pa.ipc.open_stream(f))))
print(rows, peak[0] - first)
"""


def words(n: int) -> list[str]:
    rng = np.random.default_rng(5)
    return ["".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz\u00e9"), (n, 7)).tolist()]


def test_a_pretoken_is_remembered_once(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 1000)
    enc = tokens.Encoder(queries.tokenizer_path())
    enc.encode([" ".join(words(3000))])
    assert sum(len(x) for x in vars(enc).values() if isinstance(x, dict) and x is not enc.tokens.names) <= 1000


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_keeps_little_beside_its_batch(tmp_path):
    known, rng = np.array(words(200_000)), np.random.default_rng(7)
    path = str(tmp_path / "texts")
    texts = [" ".join(known[(200_000 * rng.random(500) ** 3).astype(int)]) for _ in range(5000)]
    batch = pa.record_batch([pa.array(range(5000)), pa.array(texts)], names=["doc_id", "text"])
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, batch.schema) as out:
        for _ in range(3):
            out.write_batch(batch)
    got = subprocess.run([sys.executable, "-c", CHILD, path], capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) >= 15_000 and int(got[1]) < 200, got

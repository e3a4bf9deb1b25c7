"""Operator 3: what a worker needs beside a batch of texts doesn't grow with the batch."""

import subprocess
import sys

import pytest

PROBE = """
import random, resource, sys
import pyarrow as pa
from presswork.llm import op3_lines as op3

rng = random.Random(1)
words = [f"word{i}" for i in range(500)]
line = lambda: " ".join(rng.choice(words) for _ in range(12))
texts, size = [], 0
while size < int(sys.argv[1]) << 20:
    texts.append("\\n".join(line() for _ in range(40)))
    size += len(texts[-1])
n = len(texts)
text = pa.array(texts, pa.string())
del texts
ids = pa.array(range(n), pa.int64())
if sys.argv[2] == "lines":
    batch, run = pa.RecordBatch.from_arrays([ids, ids, text], names=["id", "h", "text"]), op3._lines
else:
    drops = pa.array([[1, 3]] * n, pa.list_(pa.int32()))
    batch, run = pa.RecordBatch.from_arrays([ids, text, drops], names=["c0", "text", "drops"]), op3._drop
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = sum(b.num_rows for b in run(iter([batch])))
print(rows, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("step", ["lines", "drop"])
def test_memory_beside_a_batch(step):
    out = subprocess.run([sys.executable, "-c", PROBE, "64", step], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(out[0]) > 10_000 and int(out[1]) < 80, out

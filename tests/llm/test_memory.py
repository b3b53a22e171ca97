"""What a worker keeps after a task of the pipeline's Python stages, each in a process of its own."""

import subprocess
import sys

import pytest
from tests.conftest import ROOT

SCRIPT = """
import random, re, sys
import numpy as np, pandas, pyarrow as pa, pyspark, public_tokenizers
from docflow.llm import classifier, ngram_join, packing

class Docs:
    # gives back the function that a stage hands to mapInArrow
    sparkSession, columns, schema = None, ["doc_id", "text"], None
    def select(self, *_): return self
    def mapInArrow(self, run, _): return run

class Model:
    def scores(self, texts, reader): return np.array([len(reader.read(t)) for t in texts])

class Context:
    @staticmethod
    def get(): return Context
    @staticmethod
    def partitionId(): return 0

for m in (classifier, ngram_join, packing): m.ship = lambda _: None
pyspark.TaskContext = Context
path = public_tokenizers.path("byte_bpe_50k.json")
run = {"classifier": lambda: classifier.accepted(Docs(), Model(), -1), "ngram_join": lambda: ngram_join.hashed(Docs(), 5), "packing": lambda: packing.pieces(Docs(), path)}[sys.argv[1]]()
packing.load(path)

def mb():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem): +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = random.Random(1)
    for _ in range(2):
        yield pa.record_batch([pa.array(range(4000)), pa.array([" ".join(f"w{rng.randrange(150_000)}" for _ in range(300)) for _ in range(4000)])], ["doc_id", "text"])

for _ in range(2):
    for b in batches(): pass
before = mb()
rows = sum(b.num_rows for b in run(batches()))
print(rows, mb() - before)
"""


@pytest.mark.parametrize("stage, most", [("classifier", 5), ("ngram_join", 10), ("packing", 15)])
def test_a_finished_task_gives_its_memory_back(stage, most):
    done = subprocess.run([sys.executable, "-c", SCRIPT, stage], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    rows, grown = done.stdout.split()
    assert int(rows) >= 8000 and float(grown) < most

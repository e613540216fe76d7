"""The stages keep what they should and hand on the columns of documents."""

import subprocess
import sys

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from lakemill import session
from lakemill.llm import bytewords, language_id, ngram_join, quality, scratch
from pyspark.sql import functions as F


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= before
        if name == "quality":
            wrong = [i for i in before - after if labels.get(i) == 1] + [i for i in after if labels.get(i) == 0]
            assert len(wrong) <= 0.05 * len(labels)
        if name == "near_duplicates":
            assert all(r["component_id"] == r["doc_id"] for r in ngram_join.near_duplicates(docs).collect())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.collect()} == before


def test_odd_rows(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    docs = odd_docs.select("doc_id", "text", "lang", "source")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0
    docs = no_docs.select("doc_id", "text", "lang", "source")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_back_what_it_freed():
    """Small arrays stay with the C library when freed, 60 MB of them here below one that is kept, unless they are trimmed."""
    code = f"""
import sys; sys.path.insert(0, {str(scratch.__file__).rsplit("/lakemill/", 1)[0]!r})
import numpy as np
from lakemill.llm.scratch import trim
held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
some = [np.ones(12_000) for _ in range(625)]
kept = np.ones(100)
full = held()
del some
trim()
print(full - held())
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 40 << 20


def test_batches_of_long_texts_are_small(spark):
    """A worker gets texts by bytes, not by rows alone: 400 of 100 KB are no batch of 40 MB."""
    session.ship(spark)
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes], pa.int64()), "rows": pa.array([b.num_rows], pa.int64())})

    found = texts.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in found) == 400
    assert max(r["bytes"] for r in found) <= 2 * session.ARROW_BYTES


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_an_idle_worker_holds_little():
    """When a task has ended its worker has given back what it freed; what packing keeps goes when another operator's task starts."""
    code = f"""
import sys; sys.path.insert(0, {str(scratch.__file__).rsplit("/lakemill/", 1)[0]!r})
import numpy as np
from lakemill.llm import scratch
held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
full, last = [], []
def task(batches):
    some = [np.ones(12_000) for _ in range(625)]
    last.append(np.ones(100))
    full.append(held())
    yield from batches
assert list(scratch.lean(task)(iter([1, 2]))) == [1, 2]
print(full[0] - held())
made = scratch.kept(("packing", 1), lambda: [0])
list(scratch.lean(task, keep="packing")(iter([])))
assert scratch.kept(("packing", 1), lambda: [0]) is made
list(scratch.lean(task)(iter([])))
assert scratch.kept(("packing", 1), lambda: [0]) is not made
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 40 << 20


def test_slices_change_no_result(docs):
    """Languages, features and sets of a text are the same however many texts are worked on at a time."""
    texts = docs.select("text").toArrow()["text"].combine_chunks().cast(pa.string())
    rows = pa.RecordBatch.from_arrays([texts], ["text"])
    model = language_id.LanguageModel(["a", "b", "c"], np.random.default_rng(3).random((1 << 16, 3), np.float32), np.zeros(3), 16)
    small, large = (list(bytewords.slices([rows], limit=n)) for n in (bytewords.SMALL_SLICE, 1 << 20))
    assert len(small) > len(large)
    for told in (lambda c: model.scores(c)[1], quality.features):
        one, other = (np.concatenate([told(p.column("text")) for p in some]) for some in (small, large))
        assert np.array_equal(one, other)
    one, other = ([s.tolist() for p in some for s in ngram_join._sets(p, 5)] for some in (small, large))
    assert one == other

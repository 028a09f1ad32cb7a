import random
import time

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from ebbtide.llm import common, jaccard

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def shared(tmp_path, monkeypatch):
    """The folder of the tables that a test saves."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path


def shuffled(spark) -> int:
    """Bytes of shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_"))


def test_near_duplicates_keep_no_keys_and_no_shuffles(spark, shared):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**9)}" for _ in range(5_000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(400)]
    texts += [f"{t} more" for t in texts[:100]]
    size = sum(map(len, texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark._jvm.System.gc()
    time.sleep(2)
    before = shuffled(spark)
    found = jaccard.near_duplicates_gone(docs)
    assert sum(f.stat().st_size for f in shared.rglob("*.parquet")) < size / 4
    until = time.time() + 10
    while shuffled(spark) - before > size / 4 and time.time() < until:
        time.sleep(0.2)
    assert shuffled(spark) - before < size / 4
    assert {r.doc_id for r in found.collect()} == set(range(400))


def test_a_stage_of_the_pipeline_replaces_what_it_read(spark, shared):
    packed = corpus_pipeline.run(spark, DATA)
    tables = {f.parent for f in shared.rglob("*.parquet") if "text" in pq.read_schema(f).names}
    assert len(tables) == 1
    assert packed.filter("piece = 0").count() == sum(pq.read_table(t).num_rows for t in tables)

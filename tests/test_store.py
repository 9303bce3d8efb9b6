"""Commits of the feature store, and an index that sees what comes after it."""

import pytest
from pyspark.sql import functions as F
from test_files import records

from tilewright.config import StoreConfig
from tilewright.sources.store import FeatureStore


def ids(df):
    return sorted(r["record_id"] for r in df.select("record_id").collect())


@pytest.fixture
def store(spark, tmp_path):
    made = FeatureStore(spark, str(tmp_path / "s"), StoreConfig(lists=8, probes=8))
    made.create()
    return made


def test_a_batch_is_written_once(spark, store):
    rows = records(spark, 30)
    assert store.insert(rows, "b/1") == 30 and store.insert(rows, "b/1") == 30 and store.records().count() == 30
    assert store.insert(rows) == 30 and store.records().count() == 60  # no batch, no key
    assert [c["rows"] for c in store.commits()] == [30, 30]


def test_a_stream_that_starts_again_inserts_once(spark, store, tmp_path):
    records(spark, 40).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # the second run has forgotten the first
        stream = spark.readStream.schema(records(spark, 1).schema).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(store.insert_stream).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert store.records().count() == 40


def test_a_killed_insert_leaves_nothing_visible(spark, store, monkeypatch):
    store.insert(records(spark, 20), "one")

    def die(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "_write_json", die)  # files are in place, the commit is not
    with pytest.raises(RuntimeError):
        store.insert(records(spark, 50), "two")
    monkeypatch.undo()
    assert store.records().count() == 20 and len(store._found(store.path)) > len(store._files())
    assert store.insert(records(spark, 50), "two") == 50 and store.records().count() == 70


def test_upsert_replaces_by_record(spark, store):
    store.insert(records(spark, 60))
    files = set(store._files())
    changed = records(spark, 200).filter("record_id in ('r00003', 'r00006', 'r00150')").withColumn("abnormality_score", F.lit(0.99).cast("float"))
    assert store.upsert(changed.unionByName(changed), "u") == 3 and store.upsert(changed, "u") == 3
    found = store.records()
    assert ids(found) == sorted([f"r{i:05d}" for i in range(60)] + ["r00150"])
    assert ids(found.filter("abnormality_score > 0.98")) == ["r00003", "r00006", "r00150"]
    assert files & set(store._files())  # other slides' files stay


def test_slides_of_odd_names(spark, store):
    odd = records(spark, 9).withColumn("wsi_name", F.concat(F.lit("a b%/="), "wsi_name"))
    store.insert(odd)
    store.upsert(odd.limit(4))
    assert store.records().count() == 9 and store.query_abnormal(0.0, "a b%/=s1").count() == 3


def test_the_index_sees_what_comes_later(spark, store):
    store.insert(records(spark, 50))
    store.create_index()
    store.insert(records(spark, 100).filter("record_id >= 'r00050'"))
    vector = [float(x) for x in store.records().filter("record_id = 'r00070'").first()["feature_vector"]]
    assert ids(store.search_similar(vector, 100, exact=False)) == ids(store.records()) == [f"r{i:05d}" for i in range(100)]
    assert ids(store.search_similar(vector, 7, exact=False)) == ids(store.search_similar(vector, 7))
    store.upsert(records(spark, 100).filter("record_id in ('r00001', 'r00070')").withColumn("feature_vector", F.array(*[F.lit(float(i)).cast("float") for i in range(10)])))
    assert ids(store.search_similar(vector, 200, exact=False)) == [f"r{i:05d}" for i in range(100)]  # none twice, none old
    assert ids(store.search_similar([float(i) for i in range(10)], 2, exact=False)) == ["r00001", "r00070"]
    store.refresh_index()
    assert store._unindexed() is None and ids(store.search_similar(vector, 200, exact=False)) == [f"r{i:05d}" for i in range(100)]


def test_lists_grow_with_the_table(spark, store):
    store.insert(records(spark, 40))
    store.create_index()
    store.insert(records(spark, 300))
    store.refresh_index()
    assert store.spark.read.parquet(f"{store.path}.centres").count() == 16
    vector = [float(x) for x in store.records().first()["feature_vector"]]
    assert store.search_similar(vector, 500, exact=False).count() <= 340


def test_a_table_without_commits_is_taken_over(spark, store):
    records(spark, 25).write.mode("append").partitionBy("wsi_name").parquet(store.path)
    assert store.records().count() == 25
    store.insert(records(spark, 5))
    assert store.records().count() == 30


def test_a_batch_of_many_slides_shares_files(spark, store):
    rows = records(spark, 900, 300)
    assert store.insert(rows, "many") == 900 and ids(store.records()) == ids(rows)
    assert len(store._files()) <= 4 and not [n for n in store._found(store.path)]  # as many as tasks, whatever the slides
    found = store.query_abnormal(0.0, "s7")
    assert ids(found) == ["r00007", "r00307", "r00607"] and "IsNotNull(wsi_name)" in found._jdf.queryExecution().toString()
    store.insert(records(spark, 960).filter("record_id >= 'r00900'"))  # three slides, which get folders
    assert len(store._found(store.path)) >= 3 and ids(store.records()) == [f"r{i:05d}" for i in range(960)]
    changed = records(spark, 960, 300).filter("record_id in ('r00003', 'r00950')").withColumn("abnormality_score", F.lit(0.995).cast("float"))
    assert store.upsert(changed, "u") == 2 == store.upsert(changed, "u")
    assert ids(store.records()) == [f"r{i:05d}" for i in range(960)] and ids(store.records().filter("abnormality_score > 0.99")) == ["r00003", "r00950"]


def test_the_index_covers_shared_files(spark, store):
    store.insert(records(spark, 400, 200))
    store.create_index()
    store.insert(records(spark, 800, 200).filter("record_id >= 'r00400'"))
    vector = [float(x) for x in store.records().filter("record_id = 'r00070'").first()["feature_vector"]]
    everything = [f"r{i:05d}" for i in range(800)]
    assert ids(store.search_similar(vector, 1000, exact=False)) == everything
    store.upsert(records(spark, 800, 200).filter("record_id in ('r00001', 'r00070', 'r00700')"))
    assert ids(store.search_similar(vector, 1000, exact=False)) == everything  # none twice, none old
    store.refresh_index()
    assert store._unindexed() is None and ids(store.search_similar(vector, 1000, exact=False)) == everything


def test_a_killed_first_insert_of_many_slides_leaves_nothing_visible(spark, store, monkeypatch):
    def die(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "_write_json", die)
    with pytest.raises(RuntimeError):
        store.insert(records(spark, 400, 200), "one")
    monkeypatch.undo()
    assert store.records().count() == 0 and store.insert(records(spark, 400, 200), "one") == 400 and store.records().count() == 400

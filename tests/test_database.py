import pytest

from pointloom.config import CollectionConfig, Distance, HnswConfig, OptimizerConfig
from pointloom.errors import ClosedResourceError, CollectionExistsError, CollectionNotFoundError
from pointloom.sources.database import Database


def test_names_restoring_and_closing(spark, tmp_path):
    db = Database.open(spark, str(tmp_path))
    c = db.create_collection("a", dimension=1, distance=Distance.DOT)
    c.upsert(spark.createDataFrame([(1, [1.0], "{}")], "id long, vector array<double>, payload string"))
    (tmp_path / "collections" / ".a-restored-by-a-crash").mkdir()
    assert db.names() == ["a"] and Database.open(spark, str(tmp_path)).collection("a").count() == 1
    with pytest.raises(CollectionExistsError):
        db.create_collection("a", dimension=1, distance=Distance.DOT)
    with pytest.raises(ValueError):
        db.create_collection("../a", dimension=1, distance=Distance.DOT)
    snapshot = c.create_snapshot(str(tmp_path / "s"))
    c.delete(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(CollectionExistsError):
        db.restore_collection(snapshot, "a")
    assert db.collection("a").count() == 0
    assert db.restore_collection(snapshot, "a", replace=True).count() == 1
    db.drop_collection("a")
    with pytest.raises(CollectionNotFoundError):
        db.collection("a")
    again = db.create_collection("b", dimension=1, distance=Distance.DOT)
    assert db.collection("b") is again
    db.close()
    for call in (db.names, again.count):
        with pytest.raises(ClosedResourceError):
            call()


@pytest.mark.parametrize("bad", [lambda: HnswConfig(m=1), lambda: HnswConfig(ef_construct=3), lambda: OptimizerConfig(deleted_ratio_threshold=0), lambda: CollectionConfig(0, "dot"), lambda: CollectionConfig(2, "taxicab")])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        bad()


def test_fingerprints_tell_settings_apart():
    a = CollectionConfig(2, "dot")
    assert a.fingerprint == CollectionConfig.from_dict(a.to_dict()).fingerprint != CollectionConfig(2, "cosine").fingerprint

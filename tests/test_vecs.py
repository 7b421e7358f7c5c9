import numpy as np
import pytest

from graphlode.sources.datasets import get_data, load_files
from graphlode.sources.synthetic import data_and_queries
from graphlode.sources.vecs import decode_records, encode_records, read_vecs, write_vecs


def test_records_round_trip():
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert (decode_records(encode_records(x, "f"), "f") == x).all()
    assert (decode_records(encode_records(x.astype(int), "i"), "i") == x).all()
    assert decode_records(b"", "f").shape == (0, 0)


def test_records_of_different_dimensions():
    bad = encode_records(np.zeros((1, 3)), "f") + encode_records(np.zeros((1, 2)), "f")
    with pytest.raises(OSError):
        decode_records(bad, "f")


def test_files(spark, tmp_path):
    base, queries = data_and_queries(spark, 50, 5, 6, indexed=True)
    write_vecs(base, str(tmp_path / "base"))
    got = {r.vec_id: list(r.embedding) for r in read_vecs(spark, str(tmp_path / "base")).collect()}
    assert got == {r.vec_id: list(r.embedding) for r in base.collect()}
    truth = spark.createDataFrame([(i, [i, i + 1, i + 2]) for i in range(5)], "query_id long, ids array<long>")
    write_vecs(truth, str(tmp_path / "truth"), "i", "query_id", "ids")
    write_vecs(queries, str(tmp_path / "queries"), id_col="query_id")
    data = load_files(spark, 6, 2, [str(tmp_path / n) for n in ("base", "queries", "truth")])
    assert data.truth.count() == 10
    with pytest.raises(ValueError):
        load_files(spark, 6, 2, [str(tmp_path / "base")])
    with pytest.raises(ValueError):
        load_files(spark, 7, 2, [str(tmp_path / n) for n in ("base", "queries", "truth")])


def test_unknown_data_set(spark):
    with pytest.raises(ValueError):
        get_data(spark, "nothing")


def test_generated_values_do_not_depend_on_partitions(spark):
    a, _ = data_and_queries(spark, 40, 3, 5, indexed=False)
    assert sorted(map(tuple, a.repartition(7).collect())) == sorted(map(tuple, a.coalesce(1).collect()))


def test_files_are_read_by_ranges(spark, tmp_path):
    x = np.random.default_rng(1).random((5000, 20), np.float32)
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.fvecs").write_bytes(encode_records(x[:3000], "f"))
    (tmp_path / "v/b.fvecs").write_bytes(encode_records(x[3000:], "f"))
    (tmp_path / "v/c.fvecs").write_bytes(b"")
    df = read_vecs(spark, str(tmp_path / "v"), split=21 * 4 * 500)
    assert df.rdd.getNumPartitions() == 10
    assert np.array_equal(np.array([r.embedding for r in sorted(df.collect())], np.float32), x)
    some = df.where("vec_id >= 2990 and vec_id < 3010")
    assert some.rdd.getNumPartitions() == 2 and sorted(r.vec_id for r in some.collect()) == [*range(2990, 3010)]
    assert df.where("vec_id = 4999").rdd.getNumPartitions() == 1 and df.where("vec_id > 5000").count() == 0


def test_faulty_files(spark, tmp_path):
    whole = encode_records(np.zeros((4, 3)), "f")
    for name, data in (("cut", whole[:-4]), ("mixed", whole + encode_records(np.zeros((4, 7)), "f")), ("short", b"ab")):
        (tmp_path / f"{name}.fvecs").write_bytes(data)
        with pytest.raises(Exception, match="different dimensions"):
            read_vecs(spark, str(tmp_path / f"{name}.fvecs")).count()


def test_large_parts_are_several_files(spark, tmp_path):
    rows = spark.range(400).selectExpr("id as vec_id", "array(cast(id as float), cast(1 as float)) as embedding")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        assert write_vecs(rows, str(tmp_path / "v"), roll=300) > 8
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.embedding[0] for r in read_vecs(spark, str(tmp_path / "v")).orderBy("vec_id").collect()] == [float(i) for i in range(400)]

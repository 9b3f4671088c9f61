from pyspark.sql import functions as F

from quillon.sources import generators, readers


def test_generators(spark):
    motif = [1, 2, 3, 4]
    row = spark.range(1).select(
        generators.repeat_pattern(motif, 10, 3).alias("r"),
        generators.patterned(motif, 10, 0, 4).alias("p"),
        generators.sparse_noise(generators.repeat_pattern(motif, 10), 0, 9).alias("same"),
        generators.mix_half(generators.repeat_pattern([7], 4), generators.repeat_pattern([8], 4)).alias("m"),
        generators.random_bytes(64, 5).alias("rand"),
    ).first()
    assert row.r == [motif[(i + 3) % 4] for i in range(10)]
    assert row.p == [(motif[i % 4] + i) % 256 if i and i % 4 == 0 else motif[i % 4] for i in range(10)]
    assert row.same == [motif[i % 4] for i in range(10)] and row.m == [7, 7, 8, 8]
    assert all(0 <= b < 256 for b in row.rand) and len(set(row.rand)) > 8


def test_windows(spark, tmp_path):
    (tmp_path / "a").write_bytes(bytes(600))
    (tmp_path / "b").write_bytes(bytes(range(256)) * 20)
    files = readers.files(spark, str(tmp_path))
    got = {r.path[-1]: bytes(r.w) for r in readers.window(files, 2048).collect()}
    assert got == {"b": (bytes(range(256)) * 20)[512:2560]}
    assert readers.window(files, 2048, least=None).count() == 2
    assert readers.window(files.withColumn("content", F.lit(b"")), 64, least=None).isEmpty()

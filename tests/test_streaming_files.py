import random

from kmerloom.plans import catalog, runtime


def test_arriving_files_hold_texts_and_give_the_superstring(spark, tmp_path, monkeypatch):
    rnd = random.Random(32)
    rows = [(i, "".join(rnd.choices("abcdxyz ", k=rnd.randint(0, 60)))) for i in (-7, 1, 2, 5, 8, 9, 11, 12, 40)] + [(13, None), (14, ""), (None, "lost")]
    spark.createDataFrame(rows[:-1], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, plain = [], runtime.scratch_path
    monkeypatch.setattr(runtime, "scratch_path", lambda s: made.append(plain(s)) or made[-1])
    got = sorted(map(tuple, catalog.QUERIES["streaming_superstring_files"](spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, catalog.QUERIES["streaming_superstring"](spark, str(tmp_path)).collect()))
    # the texts, not their letters, which are twice as long
    source = spark.read.parquet(made[0])
    assert source.columns == ["rec", "text"] and sorted(map(str, source.collect())) == sorted(map(str, spark.createDataFrame(rows[:-1], "rec long, text string").collect()))
    empty = tmp_path / "empty"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{empty}/documents.parquet")
    assert catalog.QUERIES["streaming_superstring_files"](spark, str(empty)).count() == 0

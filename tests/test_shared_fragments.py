import random

from kmerloom.operators import fragments, superstrings
from kmerloom.plans import catalog


def test_both_searches_share_the_fragments(spark, tmp_path, monkeypatch):
    rnd = random.Random(34)
    rows = [(i, "".join(rnd.choices("abc de", k=40))) for i in range(6)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made, plain = [], fragments.from_sequences
    for module in (fragments, superstrings):
        monkeypatch.setattr(module, "from_sequences", lambda *a: made.append(a) or plain(*a))
    row = catalog.QUERIES["loac_search_stats"](spark, str(tmp_path)).first()
    assert row.n_kmers == row.n_decoded > 0 and row.not_dearer and len(made) == 1

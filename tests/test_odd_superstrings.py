import pytest

from kmerloom.plans import catalog

#: texts without a letter, without an upper-case letter (each digit of BDE is 4, 2 or 5), and none at all
TEXTS = [(1, ""), (2, "BDE"), (3, None), (4, "plain text")]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def cased(text):
    return text.encode().hex().upper().translate(str.maketrans("0123456789ABCDEF", catalog.CASED))


def test_k_of_superstrings_without_ones(spark, folder):
    got = {r.rec: r.k for r in catalog.QUERIES["get_k"](spark, folder).collect()}
    assert got == {i: None if t is None else len(cased(t)) - len(cased(t).rstrip("acgt")) + 1 for i, t in TEXTS}
    assert got[1] == 1 and got[2] == 7


def test_objective_of_superstrings_without_runs(spark, folder):
    got = {r.rec: r.objective for r in catalog.QUERIES["ms_objective"](spark, folder).collect()}
    assert got[1] == 0 and got[2] == 2 * 6 and got[3] is None and got[4] > 2 * len("plain text") * 2

import random

import pytest

from kmerloom import cli
from kmerloom.sources import fasta
from tests import brute

FASTA = ">1\nACCCGAAC\n>2\nCGTANATGC\n>3\nAcCCGTTTAACG\n"


@pytest.mark.parametrize(
    "line",
    [
        "-k 3", "-p a -p b -k 3", "-p a", "-p a -k 0", "-p a -k -2", "-p a -k 3 -a local -d -1", "-p a -k 128", "-p a -k 128 -a local", "-p a -k 3 -d 2",
        "-p a -k 3 -d 2 -a streaming", "-p a -k 3 -a globalAC -d 2", "-p a -k 3 -m -a local", "-p a -k 3 -l -a local", "-p a -k 3 -x 4", "-p a -k 3 -a loac -x -1",
        "-p a -k 3 -a csac --precision 0", "-p a -k 3 -a nonsense", "optimize -p a -k 3 -a global", "optimize -p a -k 3 -d 2", "optimize -p a -k 3 -l", "optimize -p a -k 3 -m",
    ],
)
def test_refused(line):
    with pytest.raises(cli.Refused):
        cli.parse(line.split())


def test_accepted():
    assert cli.parse("-p a -k 128 -a globalAC".split()).a == "globalAC"
    assert cli.parse("-p a -k 5 -a pseudosimplitigs -d 2".split()).a == "local"
    assert cli.parse("-p a -k 5 -a greedy -m -l".split()).a == "global"
    assert cli.parse("-p a -k 5 -a loac --run-penalty 16 -y 2 -c".split()).run_penalty == 16
    assert cli.parse("optimize -p a -k 5".split()).a == "ones"


def test_construct_then_optimize(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(FASTA)
    (tmp_path / "none.fa").write_text(">x\nAC\n")
    truth = brute.kmer_set(["ACCCGAAC", "CGTANATGC", "AcCCGTTTAACG"], 4, True)
    for name in ("globalAC", "streaming"):
        assert cli.run(spark, f"-p {tmp_path}/a.fa -k 4 -c -a {name} -o {tmp_path}/{name}".split()) == 0
    assert cli.run(spark, f"optimize -p {tmp_path}/globalAC -k 4 -c -a runapprox -o {tmp_path}/again".split()) == 0
    for name in ("globalAC", "streaming", "again"):
        rows = fasta.read_superstring(spark, f"{tmp_path}/{name}").orderBy("rank").collect()
        assert brute.kmer_set(["".join(r.piece for r in rows)], 4, True, True) == truth
    assert cli.run(spark, f"-p {tmp_path}/none.fa -k 4".split()) == 1
    assert cli.run(spark, f"-p {tmp_path}/a.fa -k 4 -c -l".split()) == 0
    assert capsys.readouterr().out.strip().isdigit()


def test_many_part_files_and_fastq(spark, tmp_path):
    """Constructor, optimizer and decoding over eight files, from FASTQ input."""
    rnd = random.Random(6)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(300)) for _ in range(30)]
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\n{s[:120]}\n{s[120:]}\n+\n@{'I' * 299}\n" for i, s in enumerate(seqs)))
    truth = brute.kmer_set(seqs, 9, True)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert cli.run(spark, f"-p {tmp_path}/a.fq -k 9 -c -a global -o {tmp_path}/made".split()) == 0
        assert len(list((tmp_path / "made").glob("part-*"))) > 1
        assert cli.run(spark, f"optimize -p {tmp_path}/made -k 9 -c -a ones -o {tmp_path}/again".split()) == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in ("made", "again"):
        rows = fasta.read_superstring(spark, f"{tmp_path}/{name}").orderBy("rank").collect()
        assert brute.kmer_set(["".join(r.piece for r in rows)], 9, True, True) == truth

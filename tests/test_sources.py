"""Readers and sinks on small files."""

import numpy as np
import pytest

from clonoscape.sources import readers as rd
from clonoscape.sources import sinks as sk
from clonoscape.streaming import incremental


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_delimited(spark, put):
    path = put("t.tsv", "\ta\tb\n0\t1\tx\n1\t2\ty\n")
    assert rows(rd.read_table(spark, path, drop_index=True)) == [("1", "x"), ("2", "y")]
    bad = put("b.tsv", "a\tb\n1\tx\n2\ty\tz\nq\tw\n")
    assert rows(rd.read_table(spark, bad, "a int, b string", tolerant=True)) == [(1, "x")]
    marked = put("c.txt", "## one\n## two\nCASSF\t1\n")
    assert rows(rd.read_table(spark, marked, "s string, c int", header=False, comment="#")) == [("CASSF", 1)]
    assert rows(rd.read_unmarked(spark, marked)) == [("CASSF\t1",)]
    assert rows(rd.read_whitespace(spark, put("w.txt", "a   b\n1  2\n 3 4\n"), ["a", "b"])) == [("1", "2"), ("3", "4")]


def test_repertoire(spark, put):
    path = put("r.tsv", "aminoAcid\tvMax\tn\nCASSF\tTRBV1\t3\tp\nCAF\tTRBV2\n")
    assert rows(rd.read_repertoire(spark, path), "cdr3", "v_gene", "info") == [("CAF", "TRBV2", ""), ("CASSF", "TRBV1", "3\tp")]
    assert rd.read_repertoire(spark, path, header=False).count() == 3


def test_fasta(spark, put):
    path = put("v.fasta", ">X|TRBV1|q\nacg\nTT\n\n>TRBV2\nMK\n")
    assert rows(rd.read_fasta(spark, path)) == [("TRBV1", "acgTT"), ("TRBV2", "MK")]
    pseudo = put("p.fa", ">a;b;c;d;CASSF;e\nXX\n")
    assert rows(rd.read_pseudo_fasta(spark, pseudo)) == [("CASSF",)]


def test_small_layouts(spark, put):
    assert rows(rd.read_unique_sequences(spark, put("u.txt", "CASSF x\nCASSF\nQQ\n"))) == [("CASSF", 2)]
    assert rows(rd.read_hla(spark, put("h.txt", "p1\tA*01:02\tB*07\np2\tA*01:03\n"))) == [("p1", "A*01"), ("p1", "B*07"), ("p2", "A*01")]
    assert rows(rd.read_cluster_lines(spark, put("c.txt", "3,1\n2\n"))) == [(0, "1"), (0, "3"), (1, "2")]
    assert rows(rd.read_motif_p(spark, put("m.txt", "Motif\tCounts\tp-value\nAB\t4\t0.001\n"))) == [("AB", 0.001)]
    assert rows(rd.read_frequencies(spark, put("f.txt", "TRBV1\t0.25\n"))) == [("TRBV1", 0.25)]
    a, b = put("x1.csv", "a\n1\n"), put("x2.csv", "a\n2\n")
    assert rows(rd.read_list_file(spark, put("l.txt", f"{a}\n{b}\n"), "a int", sep=","), "a") == [(1,), (2,)]
    with pytest.raises(ValueError, match="missing"):
        rd.validate(spark.range(1), ["nope"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("E1", "train", 1), ("E2", "test", 2)], ["epitope", "part", "x"])
    sk.write_split(df, f"{tmp_path}/s")
    assert rows(rd.read_split(spark, f"{tmp_path}/s", "E1", "train"), "x") == [(1,)]
    sk.write_delimited(df, f"{tmp_path}/d")
    with pytest.raises(Exception):  # noqa: B017
        sk.write_delimited(df, f"{tmp_path}/d")
    sk.write_delimited(df.limit(0), f"{tmp_path}/d", mode="ignore")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/d").count() == 2
    sk.write_clusters(df, f"{tmp_path}/c", {"thr": 7})
    assert "thr" in spark.read.text(f"{tmp_path}/c/parameters").first()[0]
    assert rows(sk.parameter_table(spark, {"a": 1})) == [("a", "1")]


def test_stream_of_repertoires(spark, tmp_path):
    reference = spark.createDataFrame([("CASSLGQYF",), ("CASSPDRYF",)], ["cdr3"])
    incremental.reference_patterns(reference).write.parquet(f"{tmp_path}/ref")
    spark.createDataFrame([(1, "CASSLGAYF"), (2, "CAWWWWWYF")], "id long, cdr3 string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, cdr3 string").parquet(f"{tmp_path}/in")
    q = incremental.start(stream, spark.read.parquet(f"{tmp_path}/ref"), "id", f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert rows(spark.read.parquet(f"{tmp_path}/out/batch=0"), "id", "matched") == [(1, "CASSLGQYF")]


def test_files_are_split_among_tasks(spark, tmp_path):
    """FASTA records and numbered lines of a file that many tasks read, with records across their borders, blank lines and Windows line ends."""
    rng = np.random.default_rng(1)
    records = [(f"gene{i}", ["".join(rng.choice(list("ACDE"), int(rng.integers(1, 70)))) for _ in range(int(rng.integers(0, 6)))]) for i in range(300)]
    fasta, lines = tmp_path / "f", tmp_path / "l"
    fasta.mkdir()
    lines.mkdir()
    for k, part in enumerate((records[:250], records[250:])):
        (fasta / f"{k}.fa").write_text("".join(f">x|{n}|y\r\n" + "".join(f"{s}\n" + "\n" * (len(s) % 3 == 0) for s in ss) for n, ss in part))
    (lines / "c.txt").write_text("".join((", ".join(f"m{i}-{j}" for j in range(i % 4 + 1)) if i % 7 != 3 else "") + "\n" for i in range(900)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert spark.read.text(str(fasta)).rdd.getNumPartitions() > 4
        got = {r["name"]: r["sequence"] for r in rd.read_fasta(spark, str(fasta)).collect()}
        members = sorted((r["cluster"], r["member"]) for r in rd.read_cluster_lines(spark, str(lines)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert got == {n: "".join(ss) for n, ss in records}
    assert members == sorted((i, f"m{i}-{j}") for i in range(900) if i % 7 != 3 for j in range(i % 4 + 1))

import gzip

from pyspark.sql import functions as F

from cladeflow.sources import readers, sinks


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.strip("\n").split("\n")], "value string")


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1/1 x\nACD\nEF\n>\nAAA\n>empty\n>r1/2\nGH>I\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\r\nKL\r\nM\r\n")
    got = readers.fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")])
    assert sorted((r.header, r.seq) for r in got.collect()) == [("r1/1 x", "ACDEF"), ("r1/2", "GH>I"), ("z", "KLM")]
    assert sorted(r.rid for r in readers.with_read_ids(got).collect()) == [0, 1, 2]
    sinks.fasta_lines(got, F.col("header"), F.col("seq")).write.text(str(tmp_path / "out"))
    assert readers.fasta(spark, str(tmp_path / "out")).count() == 3


def test_sam(spark):
    text = """
@SQ\tSN:c1\tLN:100
@SQ\tSN:c2\tLN:50
r1\t0\tc1\t5\t60\t10M\t*\t0\t0\tA\tI\tNM:i:1\tXA:Z:c2,+7,10M,1;c3,-9,10M,2;c4,+1,3S7M,0;
r2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI
r3\t256\tc1\t5\t60\t10M\t*\t0\t0\tA\tI\tNM:i:0
r4\t8\tc2\t5\t60\t5S5M\t*\t0\t0\tA\tI\tAS:i:3\tNM:i:0
"""
    df = lines(spark, text)
    assert {(r.contig, r.length) for r in readers.sam_headers(df).collect()} == {("c1", 100), ("c2", 50)}
    rows = readers.sam_rows(df)
    assert {r.read: r.nm for r in rows.collect()} == {"r1": 1, "r4": 0}
    assert {r.read for r in readers.sam_rows(df, True).collect()} == {"r1"}
    assert sorted(map(tuple, readers.sam_hits(rows).collect())) == [("r1", "c1"), ("r1", "c2")]


def test_tables(spark):
    assert [tuple(r) for r in readers.id_map(lines(spark, "c1 g2\nc2\tg1\n\nc3 g2")).orderBy("contig").collect()] == [("c1", "g2", 2), ("c2", "g1", 1), ("c3", "g2", 2)]
    assert sorted(map(tuple, readers.sparse_matrix(lines(spark, "#row: 2\n1\t0:2 3:0.5\n2\t1:1")).collect())) == [(1, 0, 2.0), (1, 3, 0.5), (2, 1, 1.0)]
    wide = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.5, 1.0)], "k string, a double, b double")
    assert [tuple(r) for r in readers.correlation_edges(wide, "k", 0.1).collect()] == [("a", "b", 0.5)]
    assert {r.key: r.value for r in readers.parameters(lines(spark, "A=1 # c\n# x\nb\t2")).collect()} == {"A": "1", "b": "2"}


def test_profiles_and_networks(spark, tmp_path):
    row = " ".join(["0.1"] * 20)
    moves = "0.01 4.6 4.6 0.5 0.9 0.1 *"
    (tmp_path / "m.hmm").write_text(f"HMMER3/f\nNAME  fam\nLENG  1\nSTATS LOCAL VITERBI  -8.1 0.7\nHMM  {' '.join('ACDEFGHIKLMNPQRSTVWY')}\n  m->m m->i m->d i->m i->i d->m d->d\n  COMPO {row}\n  {row}\n  {moves}\n  1 {row} 1 - - -\n  {row}\n  {moves}\n//\n")
    m = readers.hmm_profiles(spark, str(tmp_path / "m.hmm")).first()
    assert (m.name, m.length, m.mu) == ("fam", 1, -8.1) and len(m.match) == 1 and m.match[0][0] == 10000 and m.transition[0][6] == 2**31 - 1
    (tmp_path / "s.sto").write_text("# STOCKHOLM 1.0\n#=GF ID fam\n#=GF AC PF1\n#=GC seq_cons AC.D-\n//\n")
    assert tuple(readers.stockholm(spark, str(tmp_path / "s.sto")).first()) == ("fam", "PF1", "ACD")
    (tmp_path / "n.gexf").write_text('<gexf><graph><nodes><node id="1" label="a"/><node id="2" label="b"/></nodes><edges><edge source="1" target="2" weight="0.5"/></edges></graph></gexf>')
    nodes, edges = readers.gexf(spark, str(tmp_path / "n.gexf"))
    assert nodes.count() == 2 and edges.first()["_weight"] == 0.5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("AC-D*E",), ("ACD*",)], "seq string")
    assert [r.seq for r in sinks.assembled(df).collect()] == ["ACD", "ACD*"]
    text = spark.createDataFrame([("A" * 70, "B" * 70, "|" * 70)], "q string, t string, m string").select(sinks.alignment_blocks(F.col("q"), F.col("t"), F.col("m")).alias("x")).first().x
    assert text.split("\n\n")[1] == "A" * 10 + "\n" + "|" * 10 + "\n" + "B" * 10
    sinks.index_tables({"seqs": df}, str(tmp_path / "ix"))
    assert sinks.load_index(spark, str(tmp_path / "ix"), ["seqs"])["seqs"].count() == 2

"""Readers and writers on files written here, and the incremental run."""

import gzip

import pytest

from seqloom.sources import fasta, sinks, structures, tables
from seqloom.streaming import homologs


def plain_fasta(text, upper=True):
    out, name, parts = [], None, []
    for line in text.split("\n"):
        if line.startswith("#"):
            continue
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                out.append((name, "".join(parts)))
            name, parts = line[1:], []
        elif name is not None:
            parts.append(line.upper() if upper else line)
    return out + ([(name, "".join(parts))] if name is not None else [])


CASES = [
    ">a\nACd\nEF\n>b x\n\nGH\n", "preamble\n# note\n>a\nAC\n#skip\nDE\n>empty\n>c\n  KL  \n", ">a\r\nAC\r\n>b\r\nDE\r\n", "", "no record\n", ">a\nAC\n  >b\nDE\n", ">only", "#>a\nAC\n>b\nD-e.f\n",
]


@pytest.mark.parametrize("text", CASES)
def test_fasta_reader_and_parser(spark, tmp_path, text):
    (tmp_path / "x.fasta").write_bytes(text.encode())
    found = fasta.read_fasta(spark, str(tmp_path / "x.fasta")).orderBy("block", "rec_no").collect()
    assert [(r["name"], r["sequence"]) for r in found] == plain_fasta(text)
    column = spark.createDataFrame([(1, text)], "k int, t string")
    parsed = fasta.parse_fasta(column, "t", ["k"]).orderBy("rec_no").collect()
    assert [(r["name"], r["sequence"]) for r in parsed] == plain_fasta(text)


def test_fasta_over_many_splits(spark, tmp_path):
    text = "".join(f">r{i}\n{'ACDE' * 20}\n{'FG' * (i % 7)}\n" for i in range(2000))
    (tmp_path / "big.fasta").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        frame = fasta.read_fasta(spark, str(tmp_path / "big.fasta"))
        assert frame.select("block").distinct().count() > 3
        assert [(r["name"], r["sequence"]) for r in frame.orderBy("block", "rec_no").collect()] == plain_fasta(text)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a3m_and_variants(spark, tmp_path):
    with gzip.open(tmp_path / "q.a3m.gz", "wt") as file:
        file.write(">UniRef90_A\tx\nAB-d\n>UniRef90_B\nABCe\n")
    rows = fasta.read_a3m(spark, str(tmp_path / "q.a3m.gz")).orderBy("block", "rec_no").collect()
    assert [(r["msa_id"], r["raw_seq"], r["aligned_seq"]) for r in rows] == [("q", "AB-d", "AB-"), ("q", "ABCe", "ABC")]
    (tmp_path / "v.fasta").write_text(">H1Y\nYA\n>A2C\nHC\n")
    rows = fasta.read_variants(spark, str(tmp_path / "v.fasta"), "HA").orderBy("ord").collect()
    assert [(r["ord"], r["name"], r["sequence"], r["is_wt"]) for r in rows] == [(0, "H1Y", "YA", False), (1, "A2C", "HC", False), (2, "WT", "HA", True)]


def test_lists_and_pages(spark, tmp_path):
    (tmp_path / "acc.txt").write_text("# c\n A1 \n\nB2\n")
    assert [r[0] for r in tables.read_accessions(spark, str(tmp_path / "acc.txt")).collect()] == ["A1", "B2"]
    (tmp_path / "chains.txt").write_text("1abc_A\n")
    assert tuple(tables.read_chain_list(spark, str(tmp_path / "chains.txt")).first()) == ("1abc", "A")
    (tmp_path / "bad.txt").write_text("1abc_A_B\n")
    with pytest.raises(Exception, match="not protein_chain"):
        tables.read_chain_list(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "p.json").write_text(
        '{"cluster":"c","page":0,"representativeMember":{"uniref90Id":"r"},"members":[{"uniref90Id":"a"}],"links":[{"rel":"next","href":"u"}]}\n{"cluster":"c","page":1,"members":[{"uniref90Id":"b"}]}\n'
    )
    rows = tables.read_cluster_pages(spark, str(tmp_path / "p.json")).orderBy("ord").collect()
    assert [r["u90"] for r in rows] == ["r", "a", "b"]
    assert [tuple(r) for r in tables.next_pages(spark, str(tmp_path / "p.json")).collect()] == [("c", 0, "u")]
    ids = [r["id"] for r in tables.list_inputs(spark, str(tmp_path), ".txt").orderBy("id").collect()]
    assert ids == ["acc", "bad", "chains"]
    with pytest.raises(ValueError, match="unknown formats"):
        tables.fetch_manifest(spark.createDataFrame([("a",)], "value string"), ["zip"], "x")


def pdb_line(kind, serial, atom, name, chain, number, x, b):
    return f"{kind:<6}{serial:>5} {atom:<4} {name:>3} {chain}{number:>4}    {x:>8.3f}{2.0:>8.3f}{-3.5:>8.3f}{1.0:>6.2f}{b:>6.2f}"


def test_pdb_takes_first_model_and_chain(spark, tmp_path):
    lines = ["HEADER", "MODEL        1", pdb_line("ATOM", 1, " N", "MET", "B", 1, 19.736, 50.65), pdb_line("ATOM", 2, " CA", "MET", "A", 1, 1.0, 2.0), "ENDMDL", "MODEL        2", pdb_line("ATOM", 3, " N", "GLY", "B", 1, 5.0, 1.0)]
    (tmp_path / "s1.pdb").write_text("\n".join(lines) + "\n")
    rows = structures.read_pdb_atoms(spark, str(tmp_path / "s1.pdb")).collect()
    assert [(r["structure_id"], r["chain"], r["res_num"], r["res_name"], r["atom"], r["x"], r["b_iso"], r["model"]) for r in rows] == [("s1", "B", 1, "MET", "N", 19.736, 50.65, 1)]
    assert structures.read_pdb_atoms(spark, str(tmp_path / "s1.pdb"), first_only=False).count() == 3


CIF = """data_x
_entry.id 'x y'
loop_
_pdbx_poly_seq_scheme.asym_id
_pdbx_poly_seq_scheme.mon_id
_pdbx_poly_seq_scheme.seq_id
_pdbx_poly_seq_scheme.auth_seq_num
_pdbx_poly_seq_scheme.pdb_ins_code
A MET 1 5 .
A GLY 2 ? .
#
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_asym_id
_atom_site.auth_asym_id
_atom_site.auth_comp_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.B_iso_or_equiv
_atom_site.pdbx_PDB_model_num
ATOM "CA" A X MET 5 ? 1.5 2.5 3.5 9.0 1
HETATM O B X HOH 9 ? 0 0 0 1 1
"""


def test_mmcif(spark, tmp_path):
    (tmp_path / "x.cif").write_text(CIF)
    scheme, atoms = structures.read_mmcif_tables(spark, str(tmp_path / "x.cif"))
    assert [(r["mon_id"], r["seq_id"], r["auth_seq_num"]) for r in scheme.orderBy("seq_id").collect()] == [("MET", "1", "5"), ("GLY", "2", None)]
    assert [(r["label"], r["auth"], r["atom"], r["x"], r["hetero"]) for r in atoms.orderBy("ord").collect()] == [("A", "X", "CA", 1.5, False), ("B", "X", "O", 0.0, True)]


def test_sinks_round_trip(spark, tmp_path):
    draws = spark.createDataFrame([("s", 0, "U100_a", "U90_b", 0.25, 3)], "seed string, draw long, member string, cluster string, probability double, cluster_size long")
    sinks.write_sampled(draws, str(tmp_path / "draws"))
    assert spark.read.text(str(tmp_path / "draws" / "seed=s")).first()[0] == "U100_a uniref90=U90_b probability=0.2500000000 uniref90_size=3"
    found = spark.createDataFrame([("a", "ACD", 2)], "name string, sequence string, n int")
    for _ in range(2):
        sinks.append_fasta(found, str(tmp_path / "f"), str(tmp_path / "log"))
    assert fasta.read_fasta(spark, str(tmp_path / "f")).count() == 2 and spark.read.text(str(tmp_path / "log")).first()[0] == "a 2"
    scores = spark.createDataFrame([(1, 0.1), (0, 0.2)], "ord int, score double")
    sinks.write_scores(scores, str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).schema["score"].dataType.simpleString() == "float"
    sinks.write_parquet(scores.repartition(3), str(tmp_path / "one"), single=True)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    record = spark.createDataFrame([("a", "AC", [[[1.0, 2.0, 3.0]]], [0.5])], "id string, sequence string, coords array<array<array<double>>>, scores array<double>")
    sinks.write_training_records(record, str(tmp_path / "rec"))
    assert spark.read.parquet(str(tmp_path / "rec")).first()["coords"] == [[[1.0, 2.0, 3.0]]]


def test_arriving_accessions_are_drawn_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    hierarchy = lambda: (
        spark.createDataFrame([("a", "p"), ("b", "p")], "seed string, parent string"),
        spark.createDataFrame([("p", "c")], "parent string, cluster string"),
        spark.createDataFrame([("c", "m1"), ("c", "m2")], "cluster string, member string"),
    )

    def run():
        query = homologs.sample_arriving(homologs.accession_stream(spark, str(tmp_path / "in")), hierarchy, str(tmp_path / "out"), str(tmp_path / "cp"), k=3)
        query.awaitTermination(120)
        return {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("seed").count().collect()}

    (tmp_path / "in" / "1.txt").write_text("# c\na\n")
    assert run() == {("a", 3)}
    (tmp_path / "in" / "2.txt").write_text("b\n")
    assert run() == {("a", 3), ("b", 3)}

"""Data sources, one-pass structure files, page chains, near pairs, folds and batches by length."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_sources import CASES, CIF, pdb_line, plain_fasta

from seqloom.operators import clusters as C
from seqloom.operators import scoring
from seqloom.operators import structures as R
from seqloom.sources import sinks, splits, structures


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    splits.register(spark)


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_fasta_source_in_ranges_of_any_size(tmp_path, text, size):
    (tmp_path / "x.fasta").write_bytes(text.encode())
    options = {"path": str(tmp_path), "splitbytes": str(size)}
    source = splits.FastaSource(options)
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(source.schema())
    reader = splits.FastaReader(schema, options)
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [(r["name"], r["sequence"]) for r in rows] == plain_fasta(text)
    assert [r["start"] for r in rows] == sorted(r["start"] for r in rows)


def test_fasta_source_reads_records_across_ranges(spark, tmp_path):
    text = "".join(f">r{i} x\n{'ACDE' * (i % 40)}\n{'fg' * (i % 7)}\n" for i in range(3000))
    (tmp_path / "big.fasta").write_text(text)
    frame = spark.read.format("fasta").option("splitBytes", 10_000).load(str(tmp_path))
    assert frame.rdd.getNumPartitions() > 10
    assert [(r["name"], r["sequence"]) for r in frame.orderBy("file", "start").collect()] == plain_fasta(text)
    lower = spark.read.format("fasta").option("upper", "false").option("splitBytes", 10_000).load(str(tmp_path))
    assert sorted(r["sequence"] for r in lower.collect()) == sorted(s for _, s in plain_fasta(text, upper=False))


def test_fasta_source_takes_filters_and_columns(spark, tmp_path):
    (tmp_path / "x.fasta").write_text("".join(f">r{i}\nACDE\n" for i in range(100)))
    read = spark.read.format("fasta").schema("name string").load(str(tmp_path))
    some = read.filter(F.col("name").startswith("r9")).filter(F.col("name").isin("r9", "r95", "r5"))
    assert sorted(r[0] for r in some.collect()) == ["r9", "r95"] and some.columns == ["name"]
    assert read.filter(F.length("name") == 2).count() == 10  # one that the reader doesn't take
    import gzip

    with gzip.open(tmp_path / "y.fasta.gz", "wt") as file:
        file.write(">packed\nGG\n")
    assert spark.read.format("fasta").option("splitBytes", 8).load(str(tmp_path / "y.fasta.gz")).first()["sequence"] == "GG"
    with pytest.raises(Exception, match="columns"):
        spark.read.format("fasta").schema("other string").load(str(tmp_path)).collect()


def test_pdb_source_equals_the_text_reader(spark, tmp_path):
    lines = ["HEADER", "MODEL        1", pdb_line("ATOM", 1, " N", "MET", "B", 1, 19.736, 50.65), pdb_line("ATOM", 2, " CA", "MET", "B", 1, 1.0, 2.0), pdb_line("HETATM", 2, " CA", "MET", "A", 1, 1.0, 2.0), "ENDMDL", "MODEL        2", pdb_line("ATOM", 3, " N", "GLY", "B", 1, 5.0, 1.0)]
    for k in range(3):
        (tmp_path / f"s{k}.pdb").write_text("\n".join(lines[: 5 + k]) + "\n")
    columns = ["model", "chain", "res_num", "icode", "res_name", "atom", "x", "y", "z", "b_iso", "hetero"]
    for first in (True, False):
        ours = spark.read.format("pdb").option("firstOnly", str(first)).option("splitBytes", 200).load(str(tmp_path))
        other = structures.read_pdb_atoms(spark, str(tmp_path), first_only=first)
        key = lambda df, name: sorted(tuple(r) for r in df.select(F.regexp_extract(name, r"(s\d)", 1), *columns).collect())
        assert key(ours, "file") == key(other, "structure_id")
    assert spark.read.format("pdb").load(str(tmp_path)).filter("atom = 'CA' AND chain = 'B'").count() == 3


def test_structure_files_are_parsed_once(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"x{k}.cif").write_text(CIF.replace("MET", "ALA") if k else CIF)
    scheme, atoms = structures.read_mmcif_tables(spark, str(tmp_path))
    for frame in (scheme, atoms):
        plan = frame._jdf.queryExecution().toString()
        assert "CifTables" not in plan and "Python" not in plan  # both read what one parse has stored
    assert scheme.count() == 8 and atoms.count() == 8
    only = structures.cif_rows(spark, str(tmp_path), "sites")
    assert only.columns == ["structure_id", "ord", "sites"] and only.filter("sites.label_atom_id = 'O'").count() == 4
    with pytest.raises(Exception, match="some of"):
        structures.cif_rows(spark, str(tmp_path), "bonds").collect()


def by_walk(links):
    """Chains of (page, next) by plain loops."""
    link = {}
    for page, following in links:
        if page is not None:
            known = [v for v in (link.get(page), following) if v is not None]
            link[page] = min(known) if known else None
    before = {}
    for page in sorted(link):
        if link[page] is not None:
            before.setdefault(link[page], page)
    out = {}
    for page in link:
        if page not in before:
            at, place, chain = page, 0, []
            while True:
                chain.append((at, place))
                following = link[at]
                if following is None:
                    status = "whole"
                elif following not in link or before[following] != at:
                    status = "gap"
                else:
                    at, place = following, place + 1
                    continue
                break
            out |= {p: (page, k, status) for p, k in chain}
    return {p: out.get(p, (None, None, "cycle")) for p in link}


def test_page_chains_equal_a_walk(spark):
    rng = random.Random(6)
    links = [(f"a{k:04d}", f"a{k + 1:04d}" if k < 299 else None) for k in range(300)]
    links += [(f"b{k}", f"b{(k + 1) % 9}") for k in range(9)] + [("self", "self"), ("lost", "nowhere"), ("c", "a0100"), ("d", "a0100"), ("e", None), ("e", "e2"), ("e2", None), (None, "x")]
    links += [(f"r{k}", f"r{rng.randint(0, 80)}" if rng.random() < 0.8 else None) for k in range(60)]
    df = spark.createDataFrame(links, "url string, next string").repartition(5)
    found = {r["url"]: (r["first"], r["place"], r["status"]) for r in C.chain_pages(df).collect()}
    assert found == by_walk(links)
    assert C.chain_pages(df.limit(0)).collect() == []


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    point = lambda: {c: rng.uniform(-120, 120) for c in "xyz"}
    rows = [(f"c{k % 2}", k, point() if k % 9 else None) for k in range(160)]
    df = spark.createDataFrame(rows, "chain string, pos int, ca struct<x:double,y:double,z:double>")
    near = R.near_residue_pairs(df)
    far = lambda a, b: sum((a[c] - b[c]) ** 2 for c in "xyz") ** 0.5
    wanted = sorted((m, i, j) for m, i, a in rows for n, j, b in rows if m == n and i != j and a and b and far(a, b) < 48)
    assert sorted((r["chain"], r["i"], r["j"]) for r in near.collect()) == wanted and wanted
    counted = {r["chain"]: (r["n_near"], r["n_far"]) for r in R.far_pairs(df, near).collect()}
    for chain in ("c0", "c1"):
        n = sum(m == chain and a is not None for m, _, a in rows)
        listed = sum(m == chain for m, _, _ in wanted)
        assert counted[chain] == (listed, n * (n - 1) - listed)


def test_fingerprints_fold_groups_over_batches(spark):
    rng = random.Random(8)
    rows = [(None if k % 4 == 3 else k % 4, rng.randint(0, 50), None if k % 17 == 0 else f"t{k}é") for k in range(4000)]
    df = spark.createDataFrame(rows, "g int, o int, t string").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        found = {r["g"]: r["fingerprint"] for r in C.ordered_fingerprint(df, "g", "o", "t").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for g in (0, 1, 2, None):
        own = sorted((o, t is not None, t or "") for k, o, t in rows if k == g)
        assert found[g] == hashlib.sha1("".join(t for _, _, t in own).encode()).hexdigest()
    assert C.ordered_fingerprint(df.limit(0), "g", "o", "t").collect() == []


def test_batches_by_length_pad_less(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([5, 8, 300, 40, 41])) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, n int").repartition(3)
    padded = lambda part: part["n"] * 0.0 + float(part["n"].max() * len(part))  # noqa: E731  what its batch comes to with padding
    plain = scoring.score_with(df, padded, "size", batch=16)
    sorted_ = scoring.score_with(df, padded, "size", batch=16, length="n", tokens=1000)
    assert max(r["size"] for r in sorted_.collect()) <= 1000 < max(r["size"] for r in plain.collect())
    each = lambda part: part["n"] * 2.0
    assert sorted(map(tuple, scoring.score_with(df, each, length="n").collect())) == sorted(map(tuple, scoring.score_with(df, each).collect()))
    # mean of what a row's batch is padded to, less the row's own length
    waste = lambda frame: frame.select(F.avg(F.col("longest") - F.col("n"))).first()[0]
    longest = lambda part: part["n"] * 0.0 + float(part["n"].max())
    assert waste(scoring.score_with(df, longest, "longest", batch=16, length="n", tokens=5000)) < 0.1 * waste(scoring.score_with(df, longest, "longest", batch=16))


def test_a_seed_of_very_many_draws_is_written_by_many_tasks(spark, tmp_path):
    draws = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise("s").alias("seed"), F.col("id").alias("draw"), F.lit("m").alias("member"), F.lit("c").alias("cluster"), F.lit(0.5).alias("probability"), F.lit(2).alias("cluster_size"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_sampled(draws, str(tmp_path / "d"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "d" / "seed=hot").glob("part-*"))) > 1 and spark.read.text(str(tmp_path / "d")).count() == 4000

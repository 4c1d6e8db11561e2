"""Structure files as tables."""

from __future__ import annotations

import io
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from seqloom.operators.structures import first_model_chain
from seqloom.plans.lineage import cut
from seqloom.plans.shipping import ship_package

_SCHEME = ("asym_id", "mon_id", "seq_id", "auth_seq_num", "pdb_ins_code")
_SITE = ("label_asym_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "auth_comp_id", "label_atom_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "group_PDB", "pdbx_PDB_model_num")


def read_pdb_atoms(spark: SparkSession, path: str | list[str], first_only: bool = True) -> DataFrame:
    """(structure_id, model, chain, res_num, icode, res_name, atom, x, y, z, b_iso, hetero, ord) of
    fixed-width structure files; by default of the first model's first chain.

    ``ord`` is the file order. A model number is the number of MODEL lines so far, at least 1.
    """
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    lines = spark.read.text(path).select(
        "value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/.]+)[^/]*$", 1).alias("structure_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("ord"),
    )
    kind = cut(1, 6)
    lines = lines.filter(kind.isin("ATOM", "HETATM", "MODEL"))
    window = Window.partitionBy("structure_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("model", F.greatest(F.lit(1), F.count_if(kind == "MODEL").over(window).cast("int"))).filter(kind != "MODEL")
    atoms = lines.select(
        "structure_id", "model", F.substring("value", 22, 1).alias("chain"), cut(23, 4).cast("int").alias("res_num"), cut(27, 1).alias("icode"),
        cut(18, 3).alias("res_name"), cut(13, 4).alias("atom"), cut(31, 8).cast("double").alias("x"), cut(39, 8).cast("double").alias("y"),
        cut(47, 8).cast("double").alias("z"), cut(61, 6).cast("double").alias("b_iso"), (kind == "HETATM").alias("hetero"), "ord",
    )
    return first_model_chain(atoms) if first_only else atoms


_TOKEN = re.compile(r"""'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(#.*)|(\S+)""")


def _words(text: str) -> Iterator[tuple[str, bool]]:
    """(word, quoted) of a dictionary-style file, line by line."""
    block: list[str] | None = None
    for raw in io.StringIO(text, newline=None):
        line = raw.rstrip("\n")
        if block is not None:
            if line.startswith(";"):
                yield "\n".join(block), True
                block = None
            else:
                block.append(line)
        elif line.startswith(";"):
            block = [line[1:]]
        else:
            for m in _TOKEN.finditer(line):
                if m[3] is None:
                    yield m[1] or m[2] or m[4] or "", m[4] is None


def _table_rows(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(category, row) of a dictionary-style file as they come: rows of loops one by one, single values of a
    category as one row at its end. No more than a row of a loop is held."""
    singles: dict[str, dict[str, str]] = {}
    names: list[str] = []
    values: list[str] = []
    looping = filled = False
    pending: str | None = None

    def row() -> tuple[str, dict[str, str]]:
        return names[0].split(".")[0], dict(zip([n.split(".", 1)[1] for n in names], values, strict=False))

    for word, quoted in _words(text):
        if not quoted and word == "loop_":
            if values and names and looping:
                yield row()
            names, values, looping, filled, pending = [], [], True, False, None
        elif not quoted and word.startswith("_") and not (looping and filled):
            if looping:
                names.append(word)
            else:
                pending = word
        elif not quoted and (word.startswith("_") or word.startswith("data_")):
            if values and names and looping:
                yield row()
            names, values, looping, filled, pending = [], [], False, False, word if word.startswith("_") else None
        elif pending:
            category, key = pending.split(".", 1)
            singles.setdefault(category, {})[key] = word
            pending = None
        elif looping and names:
            values.append(word)
            filled = True
            if len(values) == len(names):
                yield row()
                values = []
        else:
            filled = True
    if values and names and looping:
        yield row()
    yield from singles.items()


def _struct(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: The categories that can be asked for, and their columns.
CATEGORIES = {"scheme": ("_pdbx_poly_seq_scheme", _SCHEME), "sites": ("_atom_site", _SITE)}
#: Rows of a batch.
BATCH = 4096


def cif_rows(spark: SparkSession, path: str | list[str], wanted: str = "scheme,sites") -> DataFrame:
    """(structure_id, ord, and a struct for each of ``wanted``, one of them filled) of structure files, files in
    parallel, each parsed once. Rows leave a task as they are parsed, so it holds a file's text and a batch."""
    names = wanted.split(",")
    if set(names) - set(CATEGORIES):
        raise ValueError(f"some of {sorted(CATEGORIES)}")
    ship_package(spark)
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/.]+)[^/]*$", 1).alias("structure_id"), "value"
    )
    own = [T.StructField("structure_id", T.StringType()), T.StructField("ord", T.LongType())]
    schema = T.StructType(own + [T.StructField(n, _struct(CATEGORIES[n][1])) for n in names])
    arrow = to_arrow_schema(schema)
    of = {CATEGORIES[n][0]: n for n in names}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                seen = dict.fromkeys(names, 0)
                structure = batch.column(0)[k].as_py()
                for category, row in _table_rows(batch.column(1)[k].as_py() or ""):
                    if name := of.get(category):
                        yield {"structure_id": structure, "ord": seen[name], name: {c: row.get(c) for c in CATEGORIES[name][1]}}
                        seen[name] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = parsed(batches)
        while some := list(itertools.islice(rows, BATCH)):
            yield pa.RecordBatch.from_pylist(some, arrow)

    return files.mapInArrow(run, schema)


def read_mmcif_tables(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The sequence scheme and the atom sites of structure files.

    Scheme: (structure_id, asym_id, mon_id, seq_id, auth_seq_num, ins_code). Sites: (structure_id,
    label, auth, res_num, ins_code, res_name, atom, x, y, z, b_iso, hetero, model, ord). Files are parsed
    once; the rows of both are stored, since two tables come of them.
    """
    rows = cut(cif_rows(spark, path))
    number = lambda c: F.when(~F.col(c).isin("?", "."), F.col(c))
    scheme = rows.filter("scheme IS NOT NULL").select("structure_id", "scheme.*").withColumnRenamed("pdb_ins_code", "ins_code")
    atoms = rows.filter("sites IS NOT NULL").select("structure_id", "ord", "sites.*").select(
        "structure_id", F.col("label_asym_id").alias("label"), F.col("auth_asym_id").alias("auth"), F.col("auth_seq_id").alias("res_num"),
        F.col("pdbx_PDB_ins_code").alias("ins_code"), F.col("auth_comp_id").alias("res_name"), F.col("label_atom_id").alias("atom"),
        number("Cartn_x").cast("double").alias("x"), number("Cartn_y").cast("double").alias("y"), number("Cartn_z").cast("double").alias("z"),
        number("B_iso_or_equiv").cast("double").alias("b_iso"), (F.col("group_PDB") == "HETATM").alias("hetero"),
        F.col("pdbx_PDB_model_num").cast("int").alias("model"), "ord",
    )
    return scheme.withColumn("auth_seq_num", number("auth_seq_num")), atoms

"""Residue tables: atoms to backbones, sequence alignment of structures, geometric features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import geometry as G
from seqloom.functions.columns import lit_array

# Residue names and their letters.
RESIDUES = (
    ("ALA", "A"), ("ARG", "R"), ("ASN", "N"), ("ASP", "D"), ("CYS", "C"), ("GLN", "Q"), ("GLU", "E"), ("GLY", "G"), ("HIS", "H"), ("ILE", "I"),
    ("LEU", "L"), ("LYS", "K"), ("MET", "M"), ("PHE", "F"), ("PRO", "P"), ("SER", "S"), ("THR", "T"), ("TRP", "W"), ("TYR", "Y"), ("VAL", "V"),
)
MODIFIED = (("MSE", "M"), ("SEC", "U"), ("PYL", "O"))
WATER = ("HOH", "DOD", "WAT")
BACKBONE = ("N", "CA", "C")
#: Missing values of an insertion code.
NO_CODE = ("", ".", "?")


def residue_letter(name: Column, modified: bool = True) -> Column:
    """One-letter code of a residue name; unknown ones are X. ``modified``: also MSE, SEC and PYL."""
    table = RESIDUES + (MODIFIED if modified else ())
    names = lit_array([n for n, _ in table], "string")
    letters = lit_array([c for _, c in table], "string")
    return F.coalesce(F.get(letters, (F.array_position(names, F.upper(F.trim(name))) - 1).cast("int")), F.lit("X"))


def backbone(atoms: DataFrame, keys: list[str], atom: str = "atom", order: str = "ord", extra: list[str] | None = None) -> DataFrame:
    """One row per residue with its N, CA and C points and a score.

    Of an atom met twice (alternate locations) the later one counts. The score is the CA's B-factor,
    missing where any of the three atoms is; atoms that are there stay. One conditional
    aggregation, no pivot. ``extra`` columns are taken from the residue's first atom.
    """
    place = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    last = lambda name, what: F.max_by(what, F.when(F.col(atom) == name, F.col(order)))
    found = atoms.groupBy(*keys).agg(
        *[last(name, place).alias(name.lower()) for name in BACKBONE],
        last("CA", F.col("b_iso").cast("double")).alias("ca_b_iso"),
        *[F.min_by(c, order).alias(c) for c in extra or []],
    )
    whole = F.col("n").isNotNull() & F.col("ca").isNotNull() & F.col("c").isNotNull()
    return found.withColumn("score", F.when(whole, F.col("ca_b_iso"))).drop("ca_b_iso")


def full_backbone_count(atoms: DataFrame, keys: list[str], structure: str, atom: str = "atom") -> DataFrame:
    """(structure, n_residues, n_full): residues with all three backbone atoms."""
    each = atoms.groupBy(structure, *keys).agg(*[F.bool_or(F.col(atom) == a).alias(f"has_{a}") for a in BACKBONE])
    return each.groupBy(structure).agg(F.count("*").alias("n_residues"), F.count_if(F.expr(" AND ".join(f"has_{a}" for a in BACKBONE))).alias("n_full"))


def first_model_chain(atoms: DataFrame, structure: str = "structure_id", order: str = "ord") -> DataFrame:
    """The atoms of each structure's first model and its first chain, by file order."""
    first = atoms.groupBy(structure).agg(F.min_by(F.struct("model", "chain"), order).alias("__first"))
    same = F.col("model").eqNullSafe(F.col("__first.model")) & F.col("chain").eqNullSafe(F.col("__first.chain"))
    return atoms.join(first, structure).filter(same).drop("__first")


def insertion_code(code: Column) -> Column:
    """Blank, ``.`` and ``?`` all mean none."""
    return F.coalesce(F.when(~F.trim(code).isin(*NO_CODE), F.trim(code)), F.lit(""))


def resolve_chain(scheme: DataFrame, labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """(structure_id, chain, label) of wanted chains.

    A chain id of the scheme stands for itself; else the author id's most common label id is taken;
    else reading the row raises. ``labels``: (structure_id, auth, label), see ``modal_label``.
    """
    known = scheme.select("structure_id", F.col("asym_id").alias("chain")).distinct().withColumn("own", F.col("chain"))
    by_author = labels.select("structure_id", F.col("auth").alias("chain"), F.col("label").alias("mapped"))
    found = wanted.join(known, ["structure_id", "chain"], "left").join(by_author, ["structure_id", "chain"], "left")
    unknown = F.raise_error(F.concat(F.lit("no chain "), F.col("chain"), F.lit(" in "), F.col("structure_id"))).cast("string")
    return found.select("structure_id", "chain", F.coalesce("own", "mapped", unknown).alias("label"))


def seqres_align(scheme: DataFrame, residues: DataFrame) -> DataFrame:
    """Every position of a chain's sequence with the residue seen there, if any.

    ``scheme``: structure_id, asym_id, mon_id, seq_id, auth_seq_num, ins_code. ``residues``: structure_id,
    label, res_num, ins_code, res_name, hetero, ord and payload columns; waters go, other hetero
    residues too unless they are MSE, SEC or PYL; of a residue key met twice the last counts. The
    letter is that of the sequence's monomer.
    """
    usable = residues.filter(~F.col("res_name").isin(*WATER) & (~F.col("hetero") | F.col("res_name").isin(*[n for n, _ in MODIFIED])))
    key = ["structure_id", "asym_id", "auth_seq_num", "code"]
    usable = usable.withColumns({"asym_id": F.col("label"), "auth_seq_num": F.col("res_num").cast("int"), "code": insertion_code(F.col("ins_code"))})
    payload = [c for c in residues.columns if c not in ("structure_id", "label", "res_num", "ins_code", "hetero", "ord")]
    last = usable.groupBy(*key).agg(F.max_by(F.struct(*payload), "ord").alias("seen"))
    left = scheme.withColumns({"auth_seq_num": F.col("auth_seq_num").cast("int"), "code": insertion_code(F.col("ins_code"))})
    return left.join(last, key, "left").select("structure_id", "asym_id", F.col("seq_id").cast("int").alias("pos"), residue_letter(F.col("mon_id")).alias("aa"), "seen")


def seqres_length(scheme: DataFrame) -> DataFrame:
    """(structure_id, asym_id, length): the highest sequence position."""
    return scheme.groupBy("structure_id", "asym_id").agg(F.max(F.col("seq_id").cast("int")).alias("length"))


def local_backbone_distances(residues: DataFrame, chain: str | list[str], pos: str = "pos", n: str = "n", ca: str = "ca", c: str = "c") -> DataFrame:
    """Adds ``local``: the 36 distances between the backbone atoms of a residue and its neighbours.

    Upper triangle, row by row, over N, CA, C of the previous, own and next residue. The first and
    last residue of a chain have null. Distances are rounded to half precision, as features are kept.
    """
    chains = [chain] if isinstance(chain, str) else list(chain)
    window = Window.partitionBy(*chains).orderBy(pos)
    trio = F.struct(F.col(n).alias("n"), F.col(ca).alias("ca"), F.col(c).alias("c"))
    table = residues.withColumns({"__prev": F.lag(trio).over(window), "__next": F.lead(trio).over(window)})
    atoms = [F.col("__prev")[k] for k in ("n", "ca", "c")] + [F.col(k) for k in (n, ca, c)] + [F.col("__next")[k] for k in ("n", "ca", "c")]
    # one expression over the nine points; one for each pair would be more code than the JVM compiles
    points = F.col("__points")
    rest = lambda p, i: F.transform(F.slice(points, i + 2, 8), lambda q: G.distance(p, q))
    far = F.flatten(F.transform(F.slice(points, 1, 8), rest))
    pairs = F.transform(far, lambda d: G.rounded_to_half(d).cast("float"))
    inner = F.col("__prev").isNotNull() & F.col("__next").isNotNull()
    return table.withColumn("__points", F.array(*atoms)).withColumn("local", F.when(inner, pairs)).drop("__prev", "__next", "__points")


def residue_pairs(residues: DataFrame, chain: str = "chain", pos: str = "pos", n_distance: int = 128, n_angle: int = 128) -> DataFrame:
    """Buckets of all ordered pairs of different residues of a chain: (chain, i, j, distance_bucket,
    angle_bucket, pair_bucket).

    ``residues`` has n, ca, c points and plddt. The output is quadratic in a chain's length, as the
    features are; chains are bounded by what a protein is, and the join is on the chain.
    """
    own = residues.withColumn("normal", G.plane_normal(F.col("n"), F.col("ca"), F.col("c"))).select(chain, pos, "ca", "normal", (F.col("plddt") / 100).alias("conf"))
    a, b = own.alias("a"), own.alias("b")
    known = F.col("a.ca").isNotNull() & F.col("b.ca").isNotNull()
    d = G.distance_bucket(G.distance(F.col("a.ca"), F.col("b.ca")), n_distance)
    angle = G.angle_bucket(F.col("a.normal"), F.col("b.normal"), n_angle)
    return (
        a.join(b, (F.col(f"a.{chain}") == F.col(f"b.{chain}")) & (F.col(f"a.{pos}") != F.col(f"b.{pos}")))
        .select(F.col(f"a.{chain}").alias(chain), F.col(f"a.{pos}").alias("i"), F.col(f"b.{pos}").alias("j"), d.alias("distance_bucket"), angle.alias("angle_bucket"), known.alias("k"), F.col("a.conf").alias("ca"), F.col("b.conf").alias("cb"))
        .withColumn("pair_bucket", G.pair_bucket(F.col("distance_bucket"), F.col("angle_bucket"), F.col("k"), F.col("ca"), F.col("cb"), n_distance, n_angle))
        .drop("k", "ca", "cb")
    )


def near_residue_pairs(residues: DataFrame, chain: str = "chain", pos: str = "pos", most: float = 48.0, n_distance: int = 128) -> DataFrame:
    """Ordered pairs of different residues of a chain nearer than ``most``: (chain, i, j, distance_bucket).

    Points are dealt into cells as wide as ``most``, and a point meets those of its own and the 26 cells
    around, so the work grows with pairs that are near and not with the square of a chain's length.
    Pairs farther apart all fall into the last bucket; ``far_pairs`` counts them. Residues without a
    CA point have no pair.
    """
    cell = lambda c: F.floor(F.col(f"ca.{c}") / most).cast("long").alias(f"c{c}")
    own = residues.filter(F.col("ca").isNotNull()).select(chain, pos, "ca", cell("x"), cell("y"), cell("z"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = own.select(F.col(chain).alias("of"), F.col(pos).alias("j"), F.col("ca").alias("other"), "cx", "cy", "cz")
    for axis in ("cx", "cy", "cz"):
        around = around.withColumn("step", F.explode(steps)).withColumn(axis, F.col(axis) + F.col("step")).drop("step")
    near = own.join(around.withColumnsRenamed({c: f"{c}2" for c in ("cx", "cy", "cz")}), (F.col(chain) == F.col("of")) & (F.col("cx") == F.col("cx2")) & (F.col("cy") == F.col("cy2")) & (F.col("cz") == F.col("cz2")))
    d = G.distance(F.col("ca"), F.col("other"))
    return near.filter((F.col(pos) != F.col("j")) & (d < most)).select(chain, F.col(pos).alias("i"), "j", G.distance_bucket(d, n_distance).alias("distance_bucket"))


def far_pairs(residues: DataFrame, near: DataFrame, chain: str = "chain") -> DataFrame:
    """(chain, n_pairs, n_near, n_far): how many ordered pairs of a chain's residues are not among ``near``."""
    every = residues.filter(F.col("ca").isNotNull()).groupBy(chain).agg((F.count("*") * (F.count("*") - 1)).alias("n_pairs"))
    listed = near.groupBy(chain).agg(F.count("*").alias("n_near"))
    found = every.join(listed, chain, "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    return found.withColumn("n_far", F.col("n_pairs") - F.col("n_near"))

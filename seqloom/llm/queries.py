"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import alignment, chat, language, licenses, merkle, mixing, near_copies, ogg, packing, quality, secret_scan, sharding, sketches

SHARD_BYTES = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text for all documents."""
    docs = _table(spark, sf_dir, "documents")
    return sharding.extendible_shards(docs, "doc_id", F.octet_length("text"), SHARD_BYTES, content=F.col("text"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
big AS (SELECT depth, h >> (60 - depth) AS prefix FROM d, generate_series(0, 40) AS g(depth)
        GROUP BY ALL HAVING sum(n_bytes) > {SHARD_BYTES} AND count(*) > 1),
leaf AS (SELECT d.doc_id, d.n_bytes, d.h, coalesce(max(big.depth) + 1, 0)::BIGINT AS shard_depth
         FROM d LEFT JOIN big ON big.prefix = d.h >> (60 - big.depth) GROUP BY d.doc_id, d.n_bytes, d.h)
SELECT doc_id, n_bytes, shard_depth,
       CASE WHEN shard_depth = 0 THEN '' ELSE lpad(bin(h >> (60 - shard_depth)), shard_depth::INT, '0') END AS shard
FROM leaf
"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in one template, read back; conversation -7 comes in another layout."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    message = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
    layout = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("messages", T.ArrayType(message))])
    extra = spark.createDataFrame([(-7, [("user", control), ("assistant", control)])], layout)
    turns = chat.table_turns(table).unionByName(chat.table_turns(extra))
    back = chat.read_chat(chat.format_chat(turns)).withColumn("loss", F.array_join("loss_texts", ""))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP2_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS body,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length('{chat.OPEN}') + length({_sql_escaped('role')}) + length('{chat.MIDDLE}')
                 + length({_sql_escaped('text')}) + length('{chat.CLOSE}'))::BIGINT AS formatted_chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150% of their words, with each one's first training position."""
    plan = mixing.curriculum(_table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position")
    ).orderBy("first_position", "doc_id")


OP7_SQL = """
WITH d AS (SELECT doc_id, (source IS NULL)::INT AS no_source, coalesce(source, '') AS source,
                  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS mark FROM documents),
s AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, row_number() OVER (ORDER BY no_source, source) - 1 AS place, sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CASE place % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope FROM w),
q AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY source_size / weight, no_source, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM r),
c AS (SELECT *, rate * weight > 2.0::DOUBLE * source_size AS capped FROM q),
t AS (SELECT no_source, source, source_size, slope,
             CASE WHEN capped THEN 2.0::DOUBLE * source_size
                  ELSE coalesce((max(rate) FILTER (NOT capped) OVER ()) * weight, 0.0::DOUBLE) END AS target FROM c),
p AS (SELECT d.*, t.source_size, t.target, t.slope,
             sum(size) OVER (PARTITION BY d.no_source, d.source ORDER BY mark >> 16, mark, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)
             - size / 2.0::DOUBLE AS middle
      FROM d JOIN t USING (no_source, source)),
f AS (SELECT *, CASE WHEN size > 0 AND middle <= target THEN 1 ELSE 0 END
             + CASE WHEN size > 0 AND source_size + middle <= target THEN 1 ELSE 0 END AS copies FROM p)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN CASE WHEN middle / target <= 0 THEN 0.0::DOUBLE
            ELSE 2 * (middle / target) / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4 * slope * (middle / target))) END END AS first_position
FROM f
"""


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their edited texts, with their likeness."""
    sketch = lambda rows: sketches.with_sketch(rows, "text", "sketch")
    pairs = sketches.next_documents(_table(spark, sf_dir, "documents"), prepare=sketch, carry=("sketch",))
    pairs = pairs.withColumn("edited", sketches.edited_text(F.col("text"), F.col("next_text")))
    pairs = sketches.with_sketch(pairs, "edited", "edited_sketch")
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    # all shingles are compared only beside a text without a sample, and are made there
    whole = sketches.shingle_hashes
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.fingerprint(own).alias("fingerprint"),
        sketches.fingerprint(edited).alias("edited_fingerprint"),
        sketches.likeness(own, edited, whole(F.col("text")), whole(F.col("edited"))).alias("near_edited"),
        sketches.likeness(own, following, whole(F.col("text")), whole(F.col("next_text"))).alias("near_next"),
        sketches.containment(own, edited, whole(F.col("text")), whole(F.col("edited"))).alias("held_by_edited"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license stated in any document, with its wording differences."""
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as Ogg and read back."""
    stored = ogg.write_media(_table(spark, sf_dir, "documents"))
    return ogg.read_media(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"
    )


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy class, copies and links of all documents."""
    return near_copies.jaccard_classes(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token pieces in sequences of 4096."""
    return packing.pack_pieces(packing.token_pieces(_table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of all documents, by a model fitted on rated ones."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_on(docs, _table(spark, sf_dir, "labels"), F.expr(quality.LABEL_GRADE))
    scored = docs.select("doc_id", quality.scorer(model, spark)(F.col("text")).alias("score"))
    return scored.select("doc_id", "score.expected_grade", "score.tail_prob", (F.col("score.tail_prob") >= quality.LEAST_TAIL).alias("selected"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, by a model that has not seen those held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit_on(docs.filter(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizations of all documents."""
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents"))


MERKLE_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; where the checksum of an id is even, the text loses its line ends."""
    docs = _table(spark, sf_dir, "documents")
    without = {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf_digest([without.get(c, F.col(c)) for c in MERKLE_FIELDS]))
    return merkle.manifest(docs, list(MERKLE_FIELDS), "source", "doc_id", tampered)


def _sql_leaf(text: str) -> str:
    fields = [text if c == "text" else c for c in MERKLE_FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


def _sql_levels(name: str, leaves: str) -> str:
    """All nodes of the trees over leaves (tree, pos, n, digest), and for each its siblings before and after."""
    beside = "string_agg(o.digest, '' ORDER BY o.pos) FILTER"
    return f"""{name} AS (SELECT tree, 0 AS level, pos, n, digest FROM {leaves}
  UNION ALL SELECT tree, level + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3),
{name}_steps AS (SELECT t.tree, t.level, t.pos, coalesce({beside} (o.pos < t.pos), '') AS before, coalesce({beside} (o.pos > t.pos), '') AS after
  FROM {name} t JOIN {name} o ON o.tree = t.tree AND o.level = t.level AND o.pos // 3 = t.pos // 3 WHERE t.n > 1 GROUP BY ALL)"""


def _sql_walk(name: str, levels: str, start: str) -> str:
    """From each of start (line, tree, pos, digest, proof) up to its tree's root."""
    return f"""{name} AS (SELECT line, tree, 0 AS level, pos, digest, proof FROM {start}
  UNION ALL SELECT w.line, w.tree, w.level + 1, w.pos // 3, sha256(before || w.digest || after), w.proof || before || after
  FROM {name} w JOIN {levels}_steps s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos),
{name}_ends AS (SELECT line, tree, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof, max(level)::BIGINT AS height FROM {name} GROUP BY line, tree)"""


#: CRC-32 of decimal digits, of which the last bit is asked: a table by its rule, then byte by byte.
_SQL_CRC = """crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
crc AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id IS NOT NULL), crc_table)"""

OP13_SQL = f"""
WITH RECURSIVE {_SQL_CRC},
e AS (SELECT d.doc_id, coalesce('s' || source, '') AS tree, {_sql_leaf("text")} AS leaf, CASE WHEN crc % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} END AS changed
  FROM documents d LEFT JOIN crc ON key = doc_id),
placed AS (SELECT *, row_number() OVER () AS line, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM e),
leaves AS (SELECT tree, pos, n, leaf AS digest FROM placed),
{_sql_levels("low", "leaves")},
sources AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
tops AS (SELECT 0 AS tree, place AS pos, n, subroot AS digest FROM sources),
{_sql_levels("high", "tops")},
starts AS (SELECT line, tree, pos, coalesce(changed, leaf) AS digest, '' AS proof FROM placed),
{_sql_walk("climb", "low", "starts")},
middle AS (SELECT line, 0 AS tree, place AS pos, digest, proof FROM climb_ends JOIN sources USING (tree)),
{_sql_walk("climb_on", "high", "middle")}
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(o.proof) AS proof_sha256, o.digest AS folded_root, o.digest = r.digest AS verified,
       CASE WHEN changed IS NOT NULL THEN c.height + o.height + 1 END AS n_copied
FROM placed JOIN sources USING (tree) JOIN climb_ends c USING (line) JOIN climb_on_ends o USING (line), (SELECT digest FROM high WHERE n = 1) r
"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_chat_format": op2_chat_format,
    "op3_licenses": op3_licenses,
    "op4_ogg": op4_ogg,
    "op5_near_copies": op5_near_copies,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_secret_scan": op9_secret_scan,
    "op10_fingerprints": op10_fingerprints,
    "op11_language": op11_language,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}
ORACLE_SQL = {"op1_sharding": OP1_SQL, "op2_chat_format": OP2_SQL, "op7_mixing": OP7_SQL, "op13_merkle": OP13_SQL}

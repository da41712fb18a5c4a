"""Registered queries of the subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salarium.llm.ann import nearest
from salarium.llm.decontaminate import CONTAINMENT, SHINGLE, contaminated
from salarium.llm.html_extract import extract
from salarium.llm.importance import importance_ranks
from salarium.llm.license_scan import scan
from salarium.llm import pii
from salarium.llm.mix import MAX_REPEAT, WEIGHTS, mix_copies
from salarium.llm.secret_scan import digest, find_secrets, train
from salarium.llm.shard import LIMIT_BYTES, assign_shards
from salarium.llm.simhash import simhash_classes
from salarium.llm.suffix_dedup import removal_digest
from salarium.llm.token_align import alignment
from salarium.llm.toxicity import toxicity, train_model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix_copies(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(find_secrets(docs, train(docs)))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(50)) == 0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train_model(docs, table(spark, sf_dir, "labels")))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find_personal_data(docs, pii.train(docs)))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))


def bits_sql(text: str) -> str:
    """The first 60 bits of the MD5 of a string."""
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


ROW_SQL = "coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null')"


def op1_sql(documents: str = "documents", limit: int = LIMIT_BYTES) -> str:
    """For every document the shallowest depth at which all documents that
    share its leading bits fit."""
    return f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, {ROW_SQL} AS k FROM {documents}),
n AS (SELECT *, row_number() OVER (PARTITION BY k) - 1 AS c, row_number() OVER () AS id FROM r),
h AS (SELECT id, doc_id, n_bytes, {bits_sql("k || '#' || c::VARCHAR")} AS h FROM n),
d AS (SELECT h.*, depth, (h >> (60 - depth)) AS p FROM h, (SELECT unnest(range(0, 41))::INT AS depth)),
s AS (SELECT *, sum(n_bytes) OVER w AS b, count(*) OVER w AS m FROM d WINDOW w AS (PARTITION BY depth, p)),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth) AS i FROM s WHERE b <= {limit} OR m = 1)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS shard,
       depth, b::BIGINT AS shard_bytes, m AS shard_docs
FROM f WHERE i = 1"""


def op2_sql(documents: str = "documents", seed: int = 0, weights=WEIGHTS, repeat: int = MAX_REPEAT) -> str:
    """Targets by a closed form over the sources, copies by prefix sums."""
    w = f"list_extract([{', '.join(map(str, weights))}], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT)"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             {bits_sql(ROW_SQL)} AS h FROM {documents}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, {w} AS w, (SELECT sum(source_size) FROM s0) AS total FROM s0),
s2 AS (SELECT *, total - coalesce(sum({repeat} * source_size) OVER (ORDER BY {repeat} * source_size / w, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
             sum(w) OVER (ORDER BY {repeat} * source_size / w, source NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s1),
s3 AS (SELECT *, {repeat} * source_size * rest <= w * room AS capped FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN capped THEN ({repeat} * source_size)::DOUBLE ELSE least(
             w * (SELECT max(room::DOUBLE / rest::DOUBLE) FROM s3 WHERE NOT capped), ({repeat} * source_size)::DOUBLE) END AS target FROM s3),
o AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
        ('0x' || substr(md5('{seed}|' || coalesce('s' || d.source, 'null')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u,
        row_number() OVER (PARTITION BY d.source ORDER BY
          length(bin(size)) * 64 + floor(size / pow(2.0, greatest(length(bin(size)) - 6, 0)))::BIGINT, h, doc_id NULLS FIRST, size) - 1 AS i
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target, least(floor(u + e * (i + 1)) - floor(u + e * i), {repeat})::BIGINT * size AS taken FROM o"""


def op6_sql(documents: str = "documents", items: str = "benchmark", shingle: int = SHINGLE, containment: float = CONTAINMENT) -> str:
    """Exact containment from all shingles of both tables."""
    def shingles(source: str, keys: str) -> str:
        return f"""SELECT DISTINCT {keys}, unnest([array_to_string(w[p:p + {shingle - 1}], ' ')
  for p in range(1, greatest(len(w) - {shingle - 1}, 1) + 1)]) AS s FROM {source} WHERE len(w) > 0"""

    words = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM {documents} WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS m, min(item_id) AS item_id, any_value({words}) AS w FROM {items} WHERE text IS NOT NULL GROUP BY text),
ds AS ({shingles("d", "r, doc_id")}),
js AS ({shingles("i", "m, item_id")}),
n AS (SELECT m, count(*) AS n FROM js GROUP BY m),
h AS (SELECT r, doc_id, m, item_id, count(*) AS c FROM ds JOIN js USING (s) GROUP BY r, doc_id, m, item_id)
SELECT doc_id, item_id, c::DOUBLE / n::DOUBLE AS containment, n::INT AS n_shingles
FROM h JOIN n USING (m) WHERE c::DOUBLE / n::DOUBLE >= {containment}::DOUBLE"""


def op12_sql(documents: str = "documents", items: str = "benchmark", buckets: int = 10_000, least_words: int = 20,
             share_percent: int = 10, seed: int = 2024) -> str:
    """Buckets of the different words from a CRC table built here, gains by
    bucket, and one ordered window over all documents."""
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(text, '{capital}', '{small}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k:
             CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i)) AS crc),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM {documents}),
e AS (SELECT r, unnest(w) AS w FROM d),
b AS (SELECT unnest({words}) AS w FROM {items} WHERE text IS NOT NULL),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM e UNION SELECT w FROM b)),
y AS (SELECT w, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT) AS y FROM v),
h AS (SELECT w, xor(list_reduce(y, lambda a, z: xor(crc[xor(a, z) % 256 + 1], a >> 8), 4294967295), 4294967295) % {buckets} AS bucket
      FROM y, c),
s AS (SELECT bucket, count(*) AS s FROM e JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000::DOUBLE * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {buckets})::DOUBLE)
        / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {buckets})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM e JOIN h USING (w) JOIN g USING (bucket) GROUP BY r),
q AS (SELECT r, doc_id, coalesce(n, 0)::BIGINT AS n_features,
        coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
p AS (SELECT *, weight + floor(-1000::DOUBLE * ln(-ln((h::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM q),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS i FROM p WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN i <= {share_percent} * (SELECT count(*) FROM k) // 100 THEN i END AS rank
FROM p LEFT JOIN k USING (r)"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_html": op3_html,
    "op4_secrets": op4_secrets,
    "op5_neighbours": op5_neighbours,
    "op6_decontamination": op6_decontamination,
    "op7_licenses": op7_licenses,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_array": op10_suffix_array,
    "op11_personal_data": op11_personal_data,
    "op12_importance": op12_importance,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE = {
    "op1_sharding": op1_sql(),
    "op2_mixing": op2_sql(),
    "op6_decontamination": op6_sql(),
    "op12_importance": op12_sql(),
}

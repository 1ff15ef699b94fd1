"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .chat import rotate_perspectives
from .context_mixing import score_texts
from .embedding_dedup import near_duplicates
from .exact_dedup import exact_dedup
from .hard_negatives import mine
from .mixing import mix
from .ngram_join import ngram_classes
from .scratch import Scratch
from .sharding import shard
from .substring_dedup import shared_passages
from .toxicity import score, train
from .vector_codes import compress
from .warc import read_archives, write_archives

def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(_read(spark, sf_dir, "conversations")).selectExpr("conv_id", "perspective", "part", "piece", "n_turns", "rendered", "array_join(transform(spans, s -> concat(s.first, '-', s.end)), ',') AS spans", "n_masked")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_read(spark, sf_dir, "documents"), vocabulary(), digests=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(_read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_read(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "archives").root
    return read_archives(write_archives(_read(spark, sf_dir, "pages"), root))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score(docs, train(docs, _read(spark, sf_dir, "labels")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_read(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(_read(spark, sf_dir, "embeddings"), relabel=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat_perspectives, op2_ngram_jaccard, op3_bpe, op4_substring_dedup, op5_sharding, op6_embedding_near_dedup, op7_exact_dedup, op8_mixing, op9_warc, op10_toxicity, op11_vector_codes, op12_hard_negatives, op13_lm_scoring)}


_POLYNOMIAL, _BLOCK = 0xEDB88320, 256


def _zeros(register: int, bits: int) -> int:
    """The checksum's register after so many zero bits."""
    for _ in range(bits):
        register = register >> 1 ^ (_POLYNOMIAL if register & 1 else 0)
    return register


def _moved(register: str, bits: int) -> str:
    """SQL of _zeros: what the lowest bits bring is looked up, four at a time; the others shift."""
    among = min(bits, 32)
    looked = [f"({[_zeros(x << at, bits) for x in range(16)]}::UBIGINT[])[((({register}) >> {at}) & 15)::BIGINT + 1]" for at in range(0, among, 4)]
    found = looked.pop()
    for x in [*looked, *([f"({register}) >> {bits}"] if among < 32 else [])]:
        found = f"xor({found}, {x})"
    return found


def _lead() -> str:
    """Hex of the four bytes that bring an empty register to all ones, where the checksum begins."""
    register = 0xFFFFFFFF
    for _ in range(32):
        register = ((register ^ _POLYNOMIAL) << 1 | 1) if register >> 31 else register << 1
    return register.to_bytes(4, "little").hex().upper()


_ASSIGN = """a{i} AS (SELECT vec_id, label, p.part, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * 64 + entry) AS key
  FROM p JOIN b{i} ON p.part = b{i}.part GROUP BY vec_id, label, p.part)"""
_MEANS = """,
m{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c FROM (SELECT part, key % 64 AS entry, place, sum(x[place + 1])::BIGINT AS s, count(*) AS n FROM a{i}, range(len(x)) AS r(place) GROUP BY ALL) GROUP BY ALL),
b{j} AS (SELECT b{i}.part, b{i}.entry, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (part, entry))"""

ORACLE = {
    "op1_chat_perspectives": r"""
WITH u AS (SELECT conv_id, turn, trim(translate(coalesce(role, ''), chr(13) || chr(10), '  ')) AS speaker, coalesce(text, '') AS text, turn // 128 AS part FROM conversations),
t AS (SELECT *, ((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, speaker, text) - 1) // 128)::INT AS piece FROM u),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker NOT IN ('', 'system')),
r AS (SELECT t.conv_id, perspective, part, piece, turn, speaker, text, speaker = perspective AS own,
        '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' || chr(10) WHEN speaker = 'system' THEN 'system' || chr(10)
          WHEN speaker = '' THEN 'user' || chr(10) ELSE 'user name=' || replace(speaker, '<|', '< |') || chr(10) END AS head,
        replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT conv_id, perspective, part, piece, count(*)::INT AS n_turns, string_agg(head || body, '' ORDER BY turn, speaker, text) AS rendered,
  coalesce(string_agg((upto - length(body))::BIGINT || '-' || upto::BIGINT, ',' ORDER BY turn, speaker, text) FILTER (own), '') AS spans,
  coalesce(sum(length(body)) FILTER (own), 0)::INT AS n_masked
FROM o GROUP BY conv_id, perspective, part, piece""",
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.least, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.doc_id = c.doc_id""",
    # the checksum goes over blocks of the text's hex, zeros before the first, and over the blocks' own registers
    "op5_sharding": """
WITH t AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text, 'LEAD' || hex(encode(coalesce(text, ''))) AS h FROM documents),
z AS (SELECT row, lpad(h, (ceil(len(h) / (2 * BLOCK)) * 2 * BLOCK)::INT, '0') AS h FROM t),
k AS (SELECT row, nth, h[nth * 2 * BLOCK + 1:(nth + 1) * 2 * BLOCK] AS h FROM (SELECT row, h, unnest(range(0, len(h) // (2 * BLOCK))) AS nth FROM z)),
b AS (SELECT row, nth, [0::UBIGINT] || list_transform(range(0, BLOCK), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT) AS b FROM k),
r AS (SELECT row, nth, list_reduce(b, lambda acc, x: BYTE) AS r FROM b),
c AS (SELECT row, xor(list_reduce(list(r ORDER BY nth), lambda acc, x: xor(x, SKIP)), 4294967295)::BIGINT AS crc FROM r GROUP BY row),
d AS (SELECT doc_id, (strlen(text) + 16)::BIGINT AS size, ('0x' || md5(text)[1:15])::BIGINT AS key, crc AS text_crc32 FROM t JOIN c ON t.row = c.row),
s AS (SELECT *, ((sum(size) OVER (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size) * 40 // sum(size) OVER ())::INT AS shard FROM d)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s""".replace("LEAD", _lead()).replace("BLOCK", str(_BLOCK)).replace("BYTE", _moved("xor(acc, x)", 8)).replace("SKIP", _moved("acc", 8 * _BLOCK)),
    "op6_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT DISTINCT a AS vec_id, a AS reached FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS least FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(least, v.vec_id) AS component_id, coalesce(least, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN c ON v.vec_id = c.vec_id LEFT JOIN n ON v.vec_id = n.vec_id""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS best FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN best IS NULL OR page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to FROM m""",
    # two rounds of one step: an entry's key is its distance * 64 + its index, so the least key is the nearest, of equals the lower
    "op11_vector_codes": """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM v, range(16) AS r(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 64),
STEPS
z AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS s FROM b2),
e AS (SELECT vec_id, label, string_agg(lower(printf('%02x', key % 64)), '' ORDER BY part) AS code, sum(key // 64)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM e, z""".replace("STEPS", ",\n".join(_ASSIGN.format(i=i) + (_MEANS.format(i=i, j=i + 1) if i < 2 else "") for i in range(3)) + ","),
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM s WHERE same QUALIFY n <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3""",
}

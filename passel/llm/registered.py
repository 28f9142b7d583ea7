"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passel.llm.bpe import encode_texts
from passel.llm.collocations import collocations
from passel.llm.language_model import score_texts
from passel.llm.licenses import scan_licences, train
from passel.llm.line_dedup import drop_repeated_lines
from passel.llm.merkle import merkle_manifest
from passel.llm.mtree import exact_topk
from passel.llm.packing import pack_documents
from passel.llm.quality import fit_classifier, score_quality
from passel.llm.simhash import simhash_groups
from passel.llm.srs import near_topk
from passel.llm.suffix_dedup import drop_repeated_strings
from passel.llm.tables import checkpoint, delete, shared_folder, short_batches, table
from passel.llm.warc import read_archives, write_archives

VOCABULARY = "word_bpe_49k.json"

QUERIES = {}
ORACLE = {}


def query(function):
    """Register a query under its name; whole texts go to Python in short batches."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        short_batches(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleared = drop_repeated_lines(table(spark, folder, "documents"))
    return cleared.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op1_line_dedup"] = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (
  SELECT doc_id, line, pos, translate(
    trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
repeated AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
judged AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND r.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op2_mtree_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE["op2_mtree_topk"] = """
WITH whole AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_licences(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scan_licences(docs, train(docs))


@query
def op5_srs_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return near_topk(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_repeated_strings(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, folder, "pages"), archives)
    records = read_archives(spark, archives).where("record_type <> 'gap'")
    found = checkpoint(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    delete(spark, archives)
    return found


ORACLE["op8_warc"] = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), originals AS (
  SELECT payload_digest, max(page_id) AS original FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN o.original <> p.page_id AND p.payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o.original <> p.page_id AND p.payload_bytes >= 1000 THEN o.original END AS refers_to
FROM payloads p LEFT JOIN originals o ON p.payload_digest = o.payload_digest
"""


@query
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_texts(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score_quality(docs, fit_classifier(docs, table(spark, folder, "labels")), columns=["doc_id"])
    return scored.select("doc_id", "p_text", "prior", "p_good", "keep")


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


ORACLE["op11_collocations"] = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
runs AS (SELECT lang, [w FOR w IN regexp_split_to_array(piece, '[\x20\x09]+') IF w <> ''] AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM runs GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]), ' ') AS phrase
  FROM runs, range(1, 6) AS sizes(k) WHERE len(w) >= k
), often AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
cuts AS (
  SELECT lang, phrase, w, a, k AS size, unnest(range(1, k)) AS cut FROM split
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.cut, h.a AS l, t.a AS r, n,
    CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
  FROM cuts c JOIN often h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN often t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.cut + 1:], ' ') JOIN totals n ON n.lang = c.lang
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored
), alone AS (
  SELECT * FROM lowest s WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM split o WHERE o.lang = s.lang AND o.k > s.size AND 100 * o.a >= 100 * s.a AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')
  )
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    manifest = merkle_manifest(table(spark, folder, "documents"), tampered=tampered, tampered_fields={"n_chars": more})
    return manifest.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# DuckDB has no CRC-32; its table of 256 words is made by the rule.
ORACLE["op12_merkle"] = """
WITH RECURSIVE crc AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR n IN range(256)] AS t),
fields AS (
  SELECT doc_id, lang, [CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END FOR v IN
      [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text, CAST(n_chars + 1 AS VARCHAR)]] AS f,
    coalesce(xor(list_reduce([4294967295] || [CAST(ascii(b) AS BIGINT) FOR b IN string_split(CAST(doc_id AS VARCHAR), '')],
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 0, false) AS tampered
  FROM documents, crc
), hashed AS (
  SELECT doc_id, lang, sha256(f[1] || f[2] || f[3] || f[4] || f[5]) AS leaf,
    sha256(f[1] || f[2] || f[3] || CASE WHEN tampered THEN f[6] ELSE f[4] END || f[5]) AS start
  FROM fields
), leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM hashed),
levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY rank) AS h FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, [sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')) FOR i IN range((len(h) + 1) // 2)] FROM levels WHERE len(h) > 1
), subroots AS (
  SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM levels WHERE len(h) = 1
), crown AS (
  SELECT 0 AS level, list(subroot ORDER BY rank) AS h FROM subroots
  UNION ALL
  SELECT level + 1, [sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')) FOR i IN range((len(h) + 1) // 2)] FROM crown WHERE len(h) > 1
), beside AS (
  SELECT l.doc_id, l.leaf, 0 AS tier, v.level, (l.rank >> v.level) & 1 AS side, v.h[xor(l.rank >> v.level, 1) + 1] AS h
  FROM leaves l JOIN levels v ON v.lang IS NOT DISTINCT FROM l.lang WHERE len(v.h) > 1
  UNION ALL
  SELECT l.doc_id, l.leaf, 1, v.level, (s.rank >> v.level) & 1, v.h[xor(s.rank >> v.level, 1) + 1]
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN crown v WHERE len(v.h) > 1
), proofs AS (
  SELECT doc_id, list(CASE WHEN side = 1 THEN 'L' ELSE 'R' END || coalesce(h, '') ORDER BY tier, level) AS steps FROM beside GROUP BY doc_id
), folded AS (
  SELECT l.*, s.subroot, coalesce(p.steps, []) AS steps,
    list_reduce([start] || coalesce(p.steps, []), lambda done, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || done ELSE done || s[2:] END)) AS folded_root
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN proofs p ON p.doc_id = l.doc_id
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s[2:] FOR s IN steps], '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded, (SELECT h[1] AS root FROM crown WHERE len(h) = 1)
"""


@query
def op13_lm(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scored = score_texts(table(spark, folder, "documents"), held_out)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

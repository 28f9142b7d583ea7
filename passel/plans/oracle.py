"""The same queries in SQL, for the side-by-side check of the driver contract."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- shared parts

# Unicode whitespace and the ASCII separators at both ends.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{_BLANK}|{_BLANK}$', '', 'g')"


CLEANED = r"""
cleaned AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS domain, CAST(doc_id AS VARCHAR) AS source_id,
         'Document ' || doc_id AS title, CAST(NULL AS VARCHAR) AS url,
         trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean_text
  FROM documents
)"""

CHUNKS = (
    CLEANED
    + """,
worded AS (SELECT *, string_split(clean_text, ' ') AS w FROM cleaned WHERE length(clean_text) > 100),
started AS (
  SELECT *, unnest(range(0, 1 + CAST(greatest(0, ceil((len(w) - 500) / 150.0)) AS BIGINT))) AS i
  FROM worded WHERE len(w) >= 120
),
chunks AS (
  SELECT id, domain, source_id, title, url, CAST(i AS INTEGER) AS chunk_id,
         array_to_string(w[i * 150 + 1 : least(i * 150 + 500, len(w))], ' ') AS chunk_text,
         CAST(least(500, len(w) - i * 150) AS INTEGER) AS chunk_tokens
  FROM started
)"""
)


def encoded(name: str, source: str, key: str, text: str) -> str:
    """Sparse unit vectors ``(key, b, x)`` of the token buckets of a text."""
    return f"""
{name}_tokens AS (SELECT {key} AS key, lower(unnest(string_split({text}, ' '))) AS t FROM {source}),
{name}_counts AS (
  SELECT key, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n
  FROM {name}_tokens WHERE t <> '' GROUP BY ALL
),
{name} AS (
  SELECT key, b, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS FLOAT) AS DOUBLE) AS x FROM {name}_counts
)"""


# Query vectors are the normalised means per label; v and q are double lists.
VECTORS = """
corpus AS (
  SELECT vec_id, label, CAST(vec_id AS VARCHAR) AS id, CAST(vec_id AS VARCHAR) || '::c-1' AS uid,
         'Source' || label || chr(9) AS source, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings
),
cells AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM corpus),
means AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY ALL),
queries AS (
  SELECT CAST(label AS BIGINT) AS qid, list(m / n ORDER BY i) AS q
  FROM (SELECT *, greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12) AS n FROM means)
  GROUP BY label
)"""

IP = "round(list_dot_product(q, v), 11)"
SHARD = "CAST(CAST('0x' || substr(sha1(id), 1, 8) AS BIGINT) % 8 AS INTEGER)"


def scored(score: str = IP, where: str = "TRUE", source: str = "corpus") -> str:
    return f"""
scored AS (
  SELECT qid, {score} + 0.0 AS score, {source}.* EXCLUDE (v, vec_id)
  FROM queries CROSS JOIN {source} WHERE {where}
)"""


RANK = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, uid ASC)"


def ranked(name: str, source: str, k: int, where: str = "TRUE", columns: str = "*") -> str:
    return f"""
{name} AS (
  SELECT * FROM (SELECT {columns}, CAST({RANK} AS INTEGER) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}
)"""


HITS = "qid, rank, uid, round(score, 6) AS score"
EXACT = VECTORS + "," + scored() + "," + ranked("hits", "scored", 10)

# ---------------------------------------------------------------- sources

ORACLE["query_set_load"] = f"""
SELECT item_id, line_no, query FROM (
  SELECT item_id, CAST(i - 1 AS INTEGER) AS line_no, {stripped("parts[i]")} AS query
  FROM (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT item_id, string_split(replace(replace(
                text || chr(13) || chr(10) || chr(9) || chr(10) || chr(160) || 'last line ' || chr(160) || chr(13) || chr(11)
                     || chr(13) || chr(10) || ' ' || chr(31),
                chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM benchmark))
) WHERE length(query) > 0
"""

ORACLE["normalize_documents"] = """
SELECT sha256('wikipedia:' || source || '/' || doc_id) AS id, 'wikipedia' AS domain,
       source || '/' || doc_id AS source_id, source || '/' || doc_id AS title,
       CAST(NULL AS VARCHAR) AS url, text
FROM documents
"""

ORACLE["normalize_abstracts"] = """
SELECT sha256('pubmed:' || doc_id) AS id, 'pubmed' AS domain, CAST(doc_id AS VARCHAR) AS source_id,
       'Title ' || doc_id AS title, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS url,
       '2020-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS published_at,
       replace(text, chr(10), ' ') AS text
FROM documents
"""

ORACLE["qa_pair_join"] = """
SELECT sha256('stackexchange:' || (q.conv_id * 1000 + q.turn)) AS id, 'stackexchange' AS domain,
       CAST(q.conv_id * 1000 + q.turn AS VARCHAR) AS source_id,
       q.text || chr(10) || chr(10) || '[ANSWER]' || chr(10) || chr(10) || a.text AS text
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'
"""

ORACLE["unify_published_at"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS published_on FROM orders
"""

ORACLE["latest_run"] = """
SELECT event_id, event_type, value FROM events e
WHERE ts = (SELECT max(ts) FROM events m WHERE m.event_type = e.event_type)
"""

# ---------------------------------------------------------------- cleaning and passages

MARKED = "'[edit] ' || text || ' [12] [1, 2; 3] & <b> [edit]'"

ORACLE["clean_documents"] = rf"""
SELECT * FROM (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS domain,
         trim(regexp_replace(regexp_replace({MARKED}, '\[[0-9]+\]|\[edit\]', ' ', 'g'), '\s+', ' ', 'g')) AS clean_text
  FROM documents
) WHERE length(clean_text) > 100
"""

ORACLE["clean_citations"] = rf"""
SELECT * FROM (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS domain,
         trim(regexp_replace(regexp_replace({MARKED}, '\[[0-9,; ]+\]', ' ', 'g'), '\s+', ' ', 'g')) AS clean_text
  FROM documents
) WHERE length(clean_text) > 100
"""

ORACLE["clean_html_pages"] = r"""
SELECT * FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'),
             '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
           '<[^>]+>', ' ', 'g'), 'http\S+|www\S+', ' ', 'g'), '\s+', ' ', 'g')) AS clean_text
  FROM pages
) WHERE length(clean_text) > 100
"""

ORACLE["chunk_documents"] = f"""
WITH {CHUNKS} SELECT * FROM chunks WHERE chunk_tokens BETWEEN 120 AND 800
"""

ORACLE["chunk_documents_short_windows"] = f"""
WITH {CLEANED},
worded AS (SELECT id, string_split(clean_text, ' ') AS w FROM cleaned WHERE length(clean_text) > 100),
started AS (SELECT *, unnest(range(0, len(w), 55)) AS s FROM worded),
cut AS (
  SELECT id, s, s - 55 + 40 >= len(w) AND s > 0 AS past_end, len(w) AS n, w[s + 1 : least(s + 40, len(w))] AS piece
  FROM started
)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS INTEGER) AS chunk_id,
       array_to_string(piece, ' ') AS chunk_text, CAST(len(piece) AS INTEGER) AS chunk_tokens
FROM cut WHERE len(piece) >= 15 AND NOT past_end
"""

ORACLE["vector_metadata"] = f"WITH {CHUNKS} SELECT * EXCLUDE (chunk_text) FROM chunks"

ORACLE["encode_hashing"] = f"""
WITH {CHUNKS}, {encoded("vec", "chunks", "id || '::c' || chunk_id", "chunk_text")}
SELECT key AS uid, CAST(b AS INTEGER) AS bucket, round(x, 6) AS weight FROM vec
"""

# ---------------------------------------------------------------- fields and identifiers

ORACLE["pick_text"] = """
SELECT doc_id,
       CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN ' ' || lang
            WHEN doc_id % 4 = 2 THEN source ELSE '' END AS picked,
       lower(trim(CASE WHEN doc_id % 4 < 2 THEN source ELSE lang END)) AS resolved
FROM documents
"""

ORACLE["normalize_metadata"] = """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 <> 3 THEN lower(source) END AS domain,
       CAST(n_chars AS VARCHAR) AS source_id, CASE WHEN doc_id % 4 IN (0, 2) THEN CAST(n_chars AS INTEGER) END AS chunk_id
FROM documents
"""

ORACLE["build_uid"] = """
SELECT doc_id AS id, doc_id || '::c' || CASE WHEN toxic = 0 THEN quality ELSE -1 END AS uid FROM labels
"""

ORACLE["build_uid_by_row"] = """
SELECT doc_id, source || '::row' || (row_number() OVER (ORDER BY doc_id) - 1) AS uid FROM documents
"""

ORACLE["build_uid_suffixed"] = """
SELECT event_id, user_id || '::c-1::' || (row_number() OVER (ORDER BY event_id) - 1) AS uid FROM events
"""

ORACLE["split_uid"] = """
SELECT event_id,
       CASE event_id % 5 WHEN 0 THEN user_id || '::c' || event_id WHEN 1 THEN user_id || '::row' || event_id
            WHEN 2 THEN user_id || '::c1::c' || event_id WHEN 3 THEN user_id || '::cx'
            ELSE CAST(user_id AS VARCHAR) END AS uid,
       CAST(user_id AS VARCHAR) AS id, CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS INTEGER) END AS chunk_id
FROM events
"""

ORACLE["record_fingerprint"] = """
SELECT doc_id, substr(sha1('{"lang": "' || lang || '", "n_chars": ' || n_chars || ', "source": "' || source
                           || '", "url": null}'), 1, 12) AS fingerprint
FROM documents
"""

RUNS = """
runs AS (
  SELECT event_id, event_type, value, CASE WHEN user_id % 2 = 0 THEN 'wiki' ELSE 'multidomain' END AS domain,
         CASE WHEN k < 34 THEN '10k' WHEN k < 67 THEN '30k' ELSE '50k' END AS size_label
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
),
named AS (
  SELECT event_id, value, domain || '_' || event_type || '_llm_' || size_label || '_bench_summary.json' AS file_name,
         domain, event_type AS backend, size_label, CAST(replace(size_label, 'k', '') AS INTEGER) * 1000 AS size,
         CAST(replace(size_label, 'k', '') AS INTEGER) AS size_k
  FROM runs
)"""

ORACLE["parse_run_name"] = f"WITH {RUNS} SELECT * EXCLUDE (value) FROM named"

# ---------------------------------------------------------------- corpus

ORACLE["merge_corpora"] = """
SELECT CAST(doc_id AS VARCHAR) AS id, 'wikipedia' AS domain, CAST(NULL AS VARCHAR) AS url, length(text) AS n_chars FROM documents
UNION ALL SELECT CAST(page_id AS VARCHAR), 'web', url, length(html) FROM pages
UNION ALL SELECT conv_id || '-' || turn, 'stackexchange', NULL, length(text) FROM conversations
"""

ORACLE["corpus_slice"] = "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 150"

ORACLE["corpus_shuffle"] = """
SELECT uid, source, row_number() OVER (ORDER BY sha1(uid || ':42'), uid) - 1 AS position
FROM (SELECT vec_id || '::c-1' AS uid, 'Source' || label || chr(9) AS source FROM embeddings)
"""

DOC_SHARD = "CAST(CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 8 AS INTEGER)"

ORACLE["hash_shards"] = f"SELECT doc_id, source, {DOC_SHARD} AS shard FROM documents"

ORACLE["contiguous_shards"] = """
SELECT doc_id, source, row_index,
       CAST(row_index // CAST(ceil((SELECT count(*) FROM documents) / 8.0) AS BIGINT) AS INTEGER) AS shard
FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents)
"""

ORACLE["domain_counts_by_shard"] = f"""
SELECT shard, domain, count(*) AS n FROM (
  SELECT {DOC_SHARD} AS shard, CASE WHEN doc_id % 9 <> 0 THEN source ELSE '(null)' END AS domain FROM documents
) GROUP BY GROUPING SETS ((shard, domain), (domain))
"""

ORACLE["shard_counts"] = """
WITH placed AS (SELECT CASE WHEN label NOT IN (2, 4) THEN label END AS shard FROM embeddings)
SELECT CAST(s AS INTEGER) AS shard, count(shard) AS n
FROM (SELECT unnest(range(0, 16)) AS s) LEFT JOIN placed ON shard = s GROUP BY s
UNION ALL SELECT NULL, count(*) FROM placed WHERE shard IS NULL
"""

ORACLE["shard_manifest"] = f"""
WITH {VECTORS},
sharded AS (SELECT *, {SHARD} AS shard FROM corpus),
per_domain AS (SELECT shard, source, count(*) AS n FROM sharded GROUP BY ALL),
per_shard AS (
  SELECT shard, CAST(sum(n) AS BIGINT) AS n, string_agg(source || '=' || n, ',' ORDER BY source || '=' || n) AS domain_counts
  FROM per_domain GROUP BY shard
)
SELECT lpad(CAST(s AS VARCHAR), 3, '0') AS id, coalesce(n, 0) AS n, coalesce(domain_counts, '') AS domain_counts,
       (SELECT count(*) FROM corpus) AS n_total, 8 AS n_shards, CAST((SELECT max(len(v)) FROM corpus) AS INTEGER) AS dim,
       TRUE AS normalized, 'ip' AS index_metric, 'hash' AS split_strategy
FROM (SELECT unnest(range(0, 8)) AS s) LEFT JOIN per_shard ON shard = s
"""

ORACLE["normalize_vectors"] = """
WITH cells AS (
  SELECT vec_id, unnest(embedding) * CAST(label + 1 AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos,
       round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12), 6) AS value
FROM cells
"""

# ---------------------------------------------------------------- search

ORACLE["topk_exact_ip"] = f"WITH {EXACT} SELECT {HITS} FROM hits"

ORACLE["topk_exact_cosine"] = f"""
WITH {VECTORS}, {scored("round(list_cosine_similarity(q, v), 11)")}, {ranked("hits", "scored", 10)}
SELECT {HITS} FROM hits
"""

ORACLE["topk_exact_l2"] = f"""
WITH {VECTORS}, {scored("round(-power(list_distance(q, v), 2), 11)")}, {ranked("hits", "scored", 10)}
SELECT {HITS} FROM hits
"""

IS_WANTED = f"lower({stripped('source')}) = 'source3'"

ORACLE["topk_filter_pre"] = f"""
WITH {VECTORS}, {scored()}, {ranked("hits", "scored", 10, IS_WANTED)} SELECT {HITS} FROM hits
"""

ORACLE["topk_filter_post"] = f"""
WITH {VECTORS}, {scored()}, {ranked("fetched", "scored", 40)},
{ranked("hits", "fetched", 10, IS_WANTED, "* EXCLUDE (rank)")}
SELECT {HITS}, source FROM hits
"""

SHARDED = (
    VECTORS
    + ","
    + scored()
    + f""",
placed AS (SELECT *, {SHARD} AS shard FROM scored),
candidates AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, shard ORDER BY score DESC, uid ASC) AS place FROM placed
  ) WHERE place <= 30
)"""
)

ORACLE["topk_sharded_merge"] = f"WITH {SHARDED}, {ranked('hits', 'candidates', 10)} SELECT {HITS}, shard FROM hits"
ORACLE["topk_fanout"] = ORACLE["topk_sharded_merge"]
ORACLE["topk_sharded_filter_merge"] = f"""
WITH {SHARDED}, {ranked("hits", "candidates", 10, IS_WANTED)} SELECT {HITS}, shard, source FROM hits
"""
ORACLE["topk_sharded_filter_local"] = ORACLE["topk_sharded_filter_merge"]

COPIES = VECTORS + f""",
copies AS (
  SELECT *, {SHARD} AS shard FROM corpus UNION ALL SELECT *, CAST(({SHARD} + 3) % 8 AS INTEGER) AS shard FROM corpus
), {scored(source="copies")},
candidates AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, shard ORDER BY score DESC, uid ASC) AS place FROM scored
  ) WHERE place <= 30
)"""

ORACLE["topk_sharded_copies"] = f"WITH {COPIES}, {ranked('hits', 'candidates', 10)} SELECT {HITS} FROM hits"
ORACLE["topk_fanout_copies"] = f"""
WITH {COPIES}, best AS (SELECT qid, uid, max(score) AS score FROM candidates WHERE {IS_WANTED} GROUP BY ALL),
{ranked("hits", "best", 10)}
SELECT {HITS} FROM hits
"""

ORACLE["topk_dedup"] = f"""
WITH {VECTORS}, doubled AS (SELECT * FROM corpus UNION ALL SELECT * FROM corpus), {scored(source="doubled")},
best AS (SELECT qid, uid, max(score) AS score FROM scored GROUP BY ALL), {ranked("hits", "best", 10)}
SELECT {HITS} FROM hits
"""

ORACLE["dedup_best_hit"] = f"""
WITH {VECTORS}, doubled AS (SELECT * FROM corpus UNION ALL SELECT * FROM corpus), {scored(source="doubled")},
{ranked("fetched", "scored", 20)},
best AS (SELECT qid, uid, id, max(score) AS score FROM fetched GROUP BY ALL), {ranked("hits", "best", 10)}
SELECT {HITS}, id FROM hits
"""

ORACLE["topk_ivf_all_cells"] = ORACLE["topk_exact_ip"]


def cell_search(nprobe: int, name: str = "near") -> str:
    """Cells around the label means; every vector belongs to the closest one."""
    return f"""
{name}_assigned AS (
  SELECT * EXCLUDE (cell, place), cell FROM (
    SELECT corpus.*, qid AS cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, q), 11) DESC, qid) AS place
    FROM corpus CROSS JOIN queries
  ) WHERE place = 1
),
{name}_probes AS (
  SELECT qid, cell FROM (
    SELECT a.qid, b.qid AS cell, row_number() OVER (PARTITION BY a.qid ORDER BY round(list_cosine_similarity(a.q, b.q), 11) DESC, b.qid) AS place
    FROM queries a CROSS JOIN queries b
  ) WHERE place <= {nprobe}
),
{name}_scored AS (
  SELECT qid, {IP} AS score, c.uid, c.source FROM {name}_probes JOIN queries USING (qid) JOIN {name}_assigned c USING (cell)
), {ranked(name, f"{name}_scored", 10)}"""


ORACLE["topk_ivf"] = f"WITH {VECTORS}, {cell_search(3)} SELECT {HITS} FROM near"

def trained_cells(n_cells: int, rounds: int, seed: int = 42) -> str:
    """The centres ``(cell, c)`` after some rounds of spherical k-means from the first vectors in hash order."""
    parts = [f"""
cells0 AS (
  SELECT place AS cell, v AS c FROM (
    SELECT v, row_number() OVER (ORDER BY sha1(uid || ':{seed}'), v) - 1 AS place FROM corpus
  ) WHERE place < {n_cells}
)"""]
    for r in range(rounds):
        parts.append(f"""
placed{r} AS (
  SELECT * FROM (
    SELECT corpus.*, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 11) DESC, cell) AS place
    FROM corpus CROSS JOIN cells{r}
  ) WHERE place = 1
),
spread{r} AS (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM placed{r}),
summed{r} AS (SELECT cell, i, avg(x) AS m FROM spread{r} GROUP BY ALL),
cells{r + 1} AS (
  SELECT cells{r}.cell, coalesce(n.c, cells{r}.c) AS c
  FROM cells{r} LEFT JOIN (SELECT cell, list(m ORDER BY i) AS c FROM summed{r} GROUP BY cell) n ON n.cell = cells{r}.cell
)""")
    return ",".join(parts)


ASSIGNED = """
assigned AS (
  SELECT * FROM (
    SELECT corpus.*, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 11) DESC, cell) AS place
    FROM corpus CROSS JOIN cells2
  ) WHERE place = 1
)"""

ORACLE["topk_ivf_trained"] = f"""
WITH {VECTORS}, {trained_cells(16, 2)}, {ASSIGNED},
probes AS (
  SELECT * FROM (
    SELECT qid, q, cell, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q, c), 11) DESC, cell) AS place
    FROM queries CROSS JOIN cells2
  ) WHERE place <= 4
),
near_scored AS (SELECT qid, {IP} AS score, a.uid FROM probes p JOIN assigned a ON p.cell = a.cell),
{ranked("hits", "near_scored", 10)}
SELECT {HITS} FROM hits
"""

# Sampled queries, their exact hits without themselves, and for each number of probes the recall and the share scored.
CURVE = f"""
sampled AS (
  SELECT uid AS own, v AS q, row_number() OVER (ORDER BY sha1(uid || ':q42'), v) - 1 AS qid FROM corpus
  QUALIFY qid < 256
), sample_scored AS (
  SELECT qid, a.cell, row_number() OVER (PARTITION BY qid ORDER BY {IP} DESC, a.uid) AS rank
  FROM sampled CROSS JOIN assigned a WHERE a.uid <> own
), sample_probes AS (
  SELECT qid, cell, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q, c), 11) DESC, cell) AS nprobe
  FROM sampled CROSS JOIN cells2
), found AS (
  SELECT nprobe, count(rank) AS hits FROM sample_probes p LEFT JOIN sample_scored s ON s.qid = p.qid AND s.cell = p.cell AND rank <= 10
  GROUP BY nprobe
), read AS (
  SELECT nprobe, sum(n) AS n FROM sample_probes JOIN (SELECT cell, count(*) AS n FROM assigned GROUP BY cell) USING (cell) GROUP BY nprobe
), curve AS (
  SELECT nprobe, sum(hits) OVER (ORDER BY nprobe) / sum(hits) OVER () AS recall, sum(n) OVER (ORDER BY nprobe) / sum(n) OVER () AS share_read
  FROM found JOIN read USING (nprobe)
)"""

ORACLE["topk_exact_cells"] = ORACLE["topk_exact_l2"]

ORACLE["probe_calibration"] = f"""
WITH {VECTORS}, {trained_cells(16, 2)}, {ASSIGNED}, {CURVE}
SELECT CAST(asked AS DOUBLE) AS recall_asked, CAST(nprobe AS INTEGER) AS nprobe, round(recall, 6) AS recall, round(share_read, 6) AS share_read
FROM (SELECT unnest([0.5, 0.8, 0.9, 0.95, 1.0]) AS asked) JOIN curve ON recall >= asked
QUALIFY row_number() OVER (PARTITION BY asked ORDER BY nprobe) = 1
"""

ORACLE["topk_ivf_calibrated"] = f"""
WITH {VECTORS}, {trained_cells(16, 2)}, {ASSIGNED}, {CURVE},
probes AS (
  SELECT * FROM (
    SELECT qid, q, cell, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q, c), 11) DESC, cell) AS place
    FROM queries CROSS JOIN cells2
  ) WHERE place <= (SELECT min(nprobe) FROM curve WHERE recall >= 0.95)
),
near_scored AS (SELECT qid, {IP} AS score, a.uid FROM probes p JOIN assigned a ON p.cell = a.cell),
{ranked("hits", "near_scored", 10)}
SELECT {HITS} FROM hits
"""

ORACLE["topk_lsh_stored"] = f"""
WITH {VECTORS},
directions AS (
  SELECT t, b, i, (CAST('0x' || substr(md5('42:' || (t * 8 + b) || ':' || (i - 1)), 1, 8) AS BIGINT) % 2001 - 1000) / CAST(1000 AS DOUBLE) AS a
  FROM (SELECT unnest(range(0, 8)) AS t) CROSS JOIN (SELECT unnest(range(0, 8)) AS b) CROSS JOIN (SELECT unnest(range(1, 65)) AS i)
),
filed AS (
  SELECT vec_id, t, CAST(sum(CASE WHEN p > 0 THEN 1 << b ELSE 0 END) AS BIGINT) AS code FROM (
    SELECT vec_id, t, b, round(sum(x * a), 9) AS p
    FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM corpus) JOIN directions USING (i) GROUP BY ALL
  ) GROUP BY ALL
),
asked AS (
  SELECT qid, t, b, round(sum(x * a), 9) AS p
  FROM (SELECT qid, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM queries) JOIN directions USING (i) GROUP BY ALL
),
costs AS (
  SELECT qid, t, code, round(sum(CASE WHEN (p > 0) <> ((code >> b) & 1 = 1) THEN p * p ELSE 0 END), 9) AS cost
  FROM asked CROSS JOIN (SELECT unnest(range(0, 256)) AS code) GROUP BY ALL
),
probes AS (SELECT qid, t, code FROM costs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cost, t, code) <= 240),
candidates AS (SELECT DISTINCT qid, vec_id FROM probes JOIN filed USING (t, code)),
near_scored AS (SELECT qid, {IP} AS score, uid FROM candidates JOIN queries USING (qid) JOIN corpus USING (vec_id)),
{ranked("hits", "near_scored", 10)}
SELECT {HITS} FROM hits
"""

HASHED = """
directions AS (
  SELECT t, i, (CAST('0x' || substr(md5('42:' || t || ':' || (i - 1)), 1, 8) AS BIGINT) % 2001 - 1000) / CAST(1000 AS DOUBLE) AS a
  FROM (SELECT unnest(range(0, 8)) AS t) CROSS JOIN (SELECT unnest(range(1, 65)) AS i)
),
filed AS (
  SELECT vec_id, t, floor(round(sum(x * a), 9) / 0.5) AS h
  FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM corpus) JOIN directions USING (i) GROUP BY ALL
),
asked AS (
  SELECT qid, t, floor(round(sum(x * a), 9) / 0.5) AS h
  FROM (SELECT qid, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM queries) JOIN directions USING (i) GROUP BY ALL
),
met AS (SELECT DISTINCT qid, vec_id FROM asked JOIN filed USING (t, h))"""

ORACLE["topk_lsh"] = f"""
WITH {VECTORS}, {HASHED},
near_scored AS (
  SELECT qid, {IP} AS score, c.uid FROM met JOIN queries USING (qid) JOIN corpus c USING (vec_id)
), {ranked("hits", "near_scored", 10)}
SELECT {HITS} FROM hits
"""

ORACLE["topk_nonfinite"] = f"""
WITH {VECTORS},
scored AS (
  SELECT qid, uid, {IP} AS score, round(list_cosine_similarity(q, v), 11) AS cosine FROM queries CROSS JOIN corpus WHERE vec_id % 7 > 2
),
by_ip AS (SELECT qid, uid, score FROM scored), by_cosine AS (SELECT qid, uid, cosine AS score FROM scored),
{ranked("hits", "by_ip", 10)}, {ranked("near", "by_cosine", 10)}
SELECT {HITS}, 'exact' AS how FROM near
UNION ALL SELECT {HITS}, 'sharded' FROM hits
UNION ALL SELECT {HITS}, 'fanout' FROM hits
"""

ORACLE["search_text"] = rf"""
WITH {CHUNKS},
asked AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS query FROM benchmark),
{encoded("passage", "chunks", "id || '::c' || chunk_id", "chunk_text")},
{encoded("question", "asked", "item_id", "query")},
scored AS (
  SELECT q.key AS qid, p.key AS uid, round(sum(q.x * p.x), 11) AS score
  FROM question q JOIN passage p USING (b) GROUP BY ALL
), {ranked("hits", "scored", 10)}
SELECT {HITS} FROM hits
"""

# ---------------------------------------------------------------- hits

ORACLE["attach_metadata"] = f"WITH {EXACT} SELECT {HITS}, id, source, label FROM hits"

TEXT_HITS = ORACLE["search_text"].rsplit("SELECT", 1)[0]
TEXT_JOIN = "FROM hits JOIN (SELECT id || '::c' || chunk_id AS uid, chunk_text FROM chunks) USING (uid)"

ORACLE["hits_with_text"] = f"{TEXT_HITS} SELECT {HITS}, chunk_text AS text {TEXT_JOIN}"

ORACLE["rag_context"] = f"""
{TEXT_HITS} SELECT qid, CAST(count(*) AS INTEGER) AS n_passages,
string_agg(chunk_text, chr(10) || chr(10) ORDER BY rank) AS context {TEXT_JOIN} GROUP BY qid
"""

ORACLE["first_hit_per_query"] = f"WITH {EXACT} SELECT {HITS}, source FROM hits WHERE rank = 1"

ORACLE["topk_ivf_stored"] = ORACLE["topk_ivf_trained"]

ORACLE["search_single"] = f"""
WITH {CHUNKS},
asked AS (SELECT 0 AS item_id, 'The of and that' AS query),
{encoded("passage", "chunks", "id || '::c' || chunk_id", "chunk_text")},
{encoded("question", "asked", "item_id", "query")},
scored AS (
  SELECT CAST(q.key AS BIGINT) AS qid, p.key AS uid, round(sum(q.x * p.x), 11) AS score
  FROM question q JOIN passage p USING (b) GROUP BY ALL
), {ranked("hits", "scored", 10)}
SELECT {HITS} FROM hits
"""

ORACLE["search_full"] = f"""
{TEXT_HITS} SELECT {HITS}, id, lower(domain) AS source, title, '' AS url,
  CASE WHEN chunk_id <> 1 THEN chunk_text ELSE '' END AS text, chunk_id
FROM hits JOIN (SELECT id || '::c' || chunk_id AS uid, * FROM chunks) USING (uid)
"""

ORACLE["guarded_search"] = ORACLE["topk_exact_ip"]

ORACLE["store_similarity"] = f"""
WITH {VECTORS}, {scored("round(-power(list_distance(q, v), 2), 11)")}, {ranked("hits", "scored", 10)}
SELECT qid, rank, uid, round(1 + score, 6) AS similarity FROM hits
"""

ORACLE["model_encode"] = """
SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, ' ', '')) AS blanks FROM documents
"""

# ---------------------------------------------------------------- files

ORACLE["sharded_round_trip"] = f"""
WITH {VECTORS} SELECT {SHARD} AS shard, count(*) AS n FROM corpus GROUP BY 1
"""

ORACLE["hit_log_round_trip"] = f"""
WITH {EXACT}, logged AS (
  SELECT 'label, "' || qid || '"' AS query, rank, uid, lower(trim(source, chr(9))) AS source, round(score, 6) AS score FROM hits
)
SELECT form, logged.* FROM (SELECT unnest(['jsonl', 'csv', 'merged']) AS form) CROSS JOIN logged
"""

ORACLE["run_summary_round_trip"] = """
SELECT event_type AS backend, count(value) AS n_queries, round(avg(value), 6) AS avg_ms,
       round(quantile_cont(value, 0.5), 6) AS p50_ms, '20240110-000000-abc' AS run_id
FROM events WHERE event_type <> 'view' GROUP BY event_type
"""

ORACLE["gold_recall"] = f"""
WITH {EXACT},
gold AS (SELECT CAST(label AS BIGINT) AS qid, uid FROM corpus WHERE vec_id % 3 = 0),
judged AS (
  SELECT g.qid, count(*) AS n_gold, count(h.uid) AS n_found, min(h.rank) AS first_place
  FROM gold g LEFT JOIN hits h ON h.qid = g.qid AND h.uid = g.uid GROUP BY g.qid
)
SELECT count(*) AS n_queries, round_even(avg(n_found / greatest(n_gold, 1)), 4) AS recall_at_k,
       round_even(avg(coalesce(1.0 / first_place, 0)), 4) AS mrr
FROM judged
"""

# ---------------------------------------------------------------- evaluation


def judged(nprobe: int) -> str:
    return f"""{EXACT}, {cell_search(nprobe)},
judged AS (
  SELECT q.qid, (SELECT count(*) FROM hits h WHERE h.qid = q.qid) AS n_gold,
         count(h.uid) AS n_found, min(CASE WHEN h.uid IS NOT NULL THEN n.rank END) AS first_place
  FROM queries q LEFT JOIN near n ON n.qid = q.qid LEFT JOIN hits h ON h.qid = n.qid AND h.uid = n.uid
  GROUP BY q.qid
)"""


ORACLE["recall_mrr"] = f"""
WITH {judged(2)}
SELECT count(*) AS n_queries, round_even(avg(n_found / greatest(n_gold, 1)), 4) AS recall_at_k,
       round_even(avg(coalesce(1.0 / first_place, 0)), 4) AS mrr
FROM judged
"""

ORACLE["recall_per_query"] = f"""
WITH {judged(1)}
SELECT qid, n_gold, n_found, round(n_found / greatest(n_gold, 1), 6) AS recall,
       round(CAST(coalesce(1.0 / first_place, 0) AS DOUBLE), 6) AS reciprocal_rank
FROM judged
"""

ORACLE["topk_agreement"] = f"""
WITH {EXACT}, {cell_search(1)},
both_runs AS (
  SELECT coalesce(a.qid, b.qid) AS qid, a.uid AS a_uid, b.uid AS b_uid
  FROM hits a FULL OUTER JOIN near b ON a.qid = b.qid AND a.uid = b.uid
),
shown AS (
  SELECT qid, count(a_uid) AS n_a, count(b_uid) AS n_b,
         list(a_uid ORDER BY a_uid) FILTER (b_uid IS NULL) AS only_a,
         list(b_uid ORDER BY b_uid) FILTER (a_uid IS NULL) AS only_b
  FROM both_runs GROUP BY qid
)
SELECT qid, len(coalesce(only_a, [])) = 0 AND len(coalesce(only_b, [])) = 0 AS equal_sets,
       coalesce(array_to_string(only_a[1:5], ','), '') AS only_a, coalesce(array_to_string(only_b[1:5], ','), '') AS only_b,
       least(n_a, n_b) AS k_compared, CAST(0 AS BIGINT) AS dupes_a, CAST(0 AS BIGINT) AS dupes_b
FROM shown WHERE n_a > 0 AND n_b > 0
"""

ORACLE["agreement_ratio"] = f"""
WITH {EXACT}, {SHARDED.replace(VECTORS + ",", "").replace("scored AS (", "rescored AS (", 1).replace("FROM scored)", "FROM rescored)")},
{ranked("merged", "candidates", 10)},
compared AS (
  SELECT qid, bool_and(a.uid IS NOT NULL AND b.uid IS NOT NULL) AS same
  FROM hits a FULL OUTER JOIN merged b USING (qid, uid) GROUP BY qid
)
SELECT count(*) AS n_compared, count(*) FILTER (same) AS n_equal, count(*) FILTER (same) / count(*) AS ratio FROM compared
"""

ORACLE["hits_by_source"] = f"WITH {EXACT} SELECT source, count(*) AS n_hits FROM hits GROUP BY source"

ORACLE["hit_coverage"] = f"""
WITH {EXACT} SELECT qid, count(*) AS n_hits, count(DISTINCT source) AS n_sources FROM hits GROUP BY qid
"""

ORACLE["source_mix"] = f"""
WITH {EXACT}
SELECT CASE WHEN source = 'Source7' || chr(9) THEN 'unknown' ELSE lower(trim(source, chr(9))) END AS source, count(*) AS n_hits,
       round_even(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS share
FROM hits GROUP BY 1
"""

# ---------------------------------------------------------------- latency

ORACLE["latency_percentiles"] = """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.9), 6) AS p90_ms
FROM events GROUP BY event_type
"""

ORACLE["latency_percentiles_nearest"] = """
WITH placed AS (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place,
         count(*) OVER (PARTITION BY event_type) AS n
  FROM events
)
SELECT event_type, max(value) FILTER (place = n // 2) AS p50_ms,
       max(value) FILTER (place = CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT)) AS p90_ms
FROM placed GROUP BY event_type
"""


def summary(source: str, keys: str, value: str = "value") -> str:
    return f"""
  SELECT {keys}, count({value}) AS n_queries, round(avg({value}), 6) AS avg_ms,
         round(quantile_cont({value}, 0.5), 6) AS p50_ms, round(quantile_cont({value}, 0.9), 6) AS p90_ms,
         round(count({value}) / (sum({value}) / 1000.0), 6) AS qps, round(sum({value}), 6) AS total_elapsed_ms
  FROM {source} GROUP BY {keys}"""


ORACLE["latency_summary"] = f"SELECT *, 'similarity' AS score_type FROM ({summary('events', 'event_type')})"

SUMMARIES = RUNS + f", summaries AS ({summary('named', 'domain, backend, size')})"

_PIVOTED = ", ".join(
    f"max(p50_ms) FILTER (backend = '{b}') AS {b}" for b in ("click", "error", "purchase", "signup", "view")
)
ORACLE["summary_pivot"] = f"WITH {SUMMARIES} SELECT domain, size, {_PIVOTED} FROM summaries GROUP BY domain, size"

ORACLE["domain_gap"] = f"""
WITH {SUMMARIES}, both_domains AS (
  SELECT backend, size, max(p50_ms) FILTER (domain = 'wiki') AS single,
         max(p50_ms) FILTER (domain = 'multidomain') AS multi
  FROM summaries GROUP BY backend, size
)
SELECT *, round(multi - single, 6) AS gap, round(multi / single, 6) AS ratio FROM both_domains
"""

ORACLE["system_comparison"] = f"""
WITH {SUMMARIES}, chosen AS (SELECT * FROM summaries WHERE domain = 'multidomain' AND size = 50000)
SELECT 'small with retrieval' AS system, 'small+rag' AS type, p50_ms + p90_ms AS lat_p50_ms, avg_ms AS lat_avg_ms, qps,
       p50_ms AS retrieval_p50_ms, avg_ms AS retrieval_avg_ms
FROM chosen WHERE backend = 'click'
UNION ALL
SELECT 'big alone', 'big_no_rag', p50_ms, avg_ms, qps, NULL, NULL FROM chosen WHERE backend = 'view'
"""

ORACLE["run_record"] = f"""
WITH {EXACT}, {cell_search(2)},
judged AS ({judged(2).split("judged AS (", 1)[1]},
mixed AS (
  SELECT string_agg(entry, ',' ORDER BY entry) AS source_mix FROM (
    SELECT lower(trim(source, chr(9))) || '=' || printf('%.4f', round_even(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4)) AS entry
    FROM near GROUP BY lower(trim(source, chr(9)))
  )
),
figures AS ({summary("(SELECT 0 AS run, value FROM events)", "run")})
SELECT 'ivf' AS backend, 'vectors' AS index_key, 'ip' AS metric, 'similarity' AS score_type, 1 AS iters, 10 AS top_k,
       n_queries, avg_ms, p50_ms, p90_ms, qps, source_mix,
       (SELECT round_even(avg(n_found / greatest(n_gold, 1)), 4) FROM judged) AS recall_at_k,
       (SELECT round_even(avg(coalesce(1.0 / first_place, 0)), 4) FROM judged) AS mrr
FROM figures, mixed
"""

# ---------------------------------------------------------------- checks

ORACLE["check_alignment"] = """
SELECT count(d.doc_id) AS n_meta, count(l.doc_id) AS n_vectors, count(*) FILTER (l.doc_id IS NULL) AS meta_only,
       count(*) FILTER (d.doc_id IS NULL) AS vector_only,
       count(*) FILTER (l.doc_id IS NULL OR d.doc_id IS NULL) = 0 AS aligned
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id
"""

ORACLE["check_shards"] = f"""
SELECT count(*) AS n_shards, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n = 0) AS empty_shards, TRUE AS complete
FROM (SELECT s, count(shard) AS n FROM (SELECT unnest(range(0, 8)) AS s)
      LEFT JOIN (SELECT {DOC_SHARD} AS shard FROM documents) ON shard = s GROUP BY s)
"""

ORACLE["check_vectors"] = """
SELECT count(*) AS n_rows, count(*) FILTER (label = 5) AS n_missing, count(*) FILTER (label = 3) AS n_not_unit,
       CAST(min(len(embedding)) FILTER (label <> 5) AS INTEGER) AS min_dim,
       CAST(max(len(embedding)) FILTER (label <> 5) AS INTEGER) AS max_dim
FROM embeddings
"""

ORACLE["check_queries"] = """
SELECT qid, query, reason FROM (
  SELECT item_id AS qid, CASE WHEN i = 2 THEN ' ' || chr(9) || chr(160) ELSE parts[i] END AS query,
         CASE WHEN i = 2 OR trim(parts[i]) = '' THEN 'blank text' WHEN item_id % 3 = 0 THEN 'wrong dimension' END AS reason
  FROM (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT item_id, string_split(text, chr(10)) AS parts FROM benchmark))
) WHERE reason IS NOT NULL
"""

ORACLE["uid_uniqueness"] = f"""
WITH cells AS (SELECT sha1(text) AS uid, {DOC_SHARD} AS shard, count(*) AS n FROM documents GROUP BY ALL),
per_uid AS (SELECT uid, sum(n) AS n, count(*) AS shards FROM cells GROUP BY uid)
SELECT shard, CAST(sum(n) AS BIGINT) AS n_rows, count(uid) AS distinct_uids, count(*) FILTER (n > 1) AS repeated_uids,
       CAST(0 AS BIGINT) AS in_several_shards
FROM cells GROUP BY shard
UNION ALL
SELECT NULL, CAST(sum(n) AS BIGINT), count(uid), count(*) FILTER (n > 1), count(*) FILTER (shards > 1) FROM per_uid
"""

ORACLE["check_alignment_sums"] = ORACLE["check_alignment"]

ORACLE["uid_estimates"] = f"""
WITH exact AS ({ORACLE["uid_uniqueness"]})
SELECT shard, n_rows, distinct_uids, TRUE AS near FROM exact
"""

ORACLE["latency_sketches"] = """
SELECT event_type, count(value) AS n, TRUE AS p50_ms_near, TRUE AS p90_ms_near FROM events GROUP BY event_type
"""

ORACLE["run_folder_report"] = f"""
WITH {SUMMARIES}, gaps AS (
  SELECT size, round(max(multi - single), 6) AS largest_gap FROM (
    SELECT backend, size, max(p50_ms) FILTER (domain = 'wiki') AS single, max(p50_ms) FILTER (domain = 'multidomain') AS multi
    FROM summaries GROUP BY backend, size
  ) GROUP BY size
)
SELECT domain, size, {_PIVOTED}, any_value(largest_gap) AS largest_gap FROM summaries JOIN gaps USING (size) GROUP BY domain, size
"""

"""The queries of this package by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from quern.llm.chat import op9_chat_roles
from quern.llm.decontaminate import op3_decontamination
from quern.llm.fingerprints import op12_fingerprints
from quern.llm.langid import op1_language_id
from quern.llm.manifest import op13_manifest
from quern.llm.neardup import op6_near_duplicates
from quern.llm.nearest import op5_nearest
from quern.llm.packing import op4_packing
from quern.llm.pointintime import op11_point_in_time
from quern.llm.repeats import op7_repeated_passages
from quern.llm.secrets import op8_secret_scan
from quern.llm.toxicity import op2_toxicity
from quern.llm.warc import op10_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_nearest": op5_nearest,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_roles": op9_chat_roles,
    "op10_warc": op10_warc,
    "op11_point_in_time": op11_point_in_time,
    "op12_fingerprints": op12_fingerprints,
    "op13_manifest": op13_manifest,
}

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, {10 * j + 1}, 10))::UBIGINT >> {35 - 5 * k}::UBIGINT) & 31) + 1)::BIGINT, 1)" for j in range(4) for k in range(8))

_LOWER_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)"

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a >> 8, list_reduce([xor(a, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))), 4294967295)"

ORACLES: dict[str, str] = {
    "op5_nearest": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
  SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM
  (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0 AND len(q.e) = len(c.e))) WHERE rank <= 20""",
    "op10_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), f AS (SELECT page_id, t, min(page_id) OVER (PARTITION BY t) AS first, sha1(t) AS hex FROM p)
  SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f""",
    "op6_near_duplicates": f"""WITH RECURSIVE {_LOWER_WORDS}, s AS (SELECT doc_id, list_sort(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END) AS s FROM w WHERE len(w) > 0),
  c AS (SELECT min(doc_id) AS rep, s FROM s GROUP BY s), u AS (SELECT rep, len(s) AS n, unnest(s) AS u FROM c),
  p AS (SELECT x.rep AS a, y.rep AS b FROM u x JOIN u y ON x.u = y.u AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
  e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a AS rep, min(b) AS least FROM r GROUP BY a)
  SELECT doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, coalesce(least, c.rep, doc_id) AS component_id, doc_id = coalesce(least, c.rep, doc_id) AS kept FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN c ON c.s = s.s LEFT JOIN m USING (rep)""",
    "op7_repeated_passages": f"""WITH {_LOWER_WORDS}, x AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50), h AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(w[i:i+49], ' ')) AS h FROM x),
  d AS (SELECT doc_id, pos FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1)), g AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, true)::INTEGER AS fresh FROM d),
  n AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM g) SELECT doc_id, min(pos)::INTEGER AS start_word, (max(pos) + 50 - min(pos))::INTEGER AS n_words FROM n GROUP BY doc_id, span""",
    "op11_point_in_time": """WITH h AS (SELECT *, sha256(doc_id::VARCHAR) AS h FROM documents), v AS (SELECT doc_id, source, n_chars, lang, ('0x' || h[1:8])::BIGINT % 20000 AS event, ('0x' || h[1:8])::BIGINT % 20000 - 60 + ('0x' || h[9:16])::BIGINT % 300 AS arrival, ('0x' || h[1:8])::BIGINT % 20000 + ('0x' || h[17:24])::BIGINT % 900 AS expiry FROM h),
  a AS (SELECT row_number() OVER () AS n, l.doc_id, s.source, ('0x' || sha256(l.doc_id::VARCHAR)[25:32])::BIGINT % 20000 AS t FROM labels l LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) s USING (doc_id)),
  w AS (SELECT n, v.*, row_number() OVER (PARTITION BY n ORDER BY event DESC, arrival, v.doc_id DESC, expiry DESC) AS r FROM a JOIN v ON v.source = a.source AND event <= t AND arrival <= t AND t < expiry)
  SELECT a.doc_id, t, w.doc_id AS version_id, t - event AS age, CASE WHEN w.n IS NULL THEN 'none' WHEN t - event > 60 THEN 'stale' ELSE 'fresh' END AS status, CASE WHEN t - event <= 60 THEN n_chars END AS n_chars, CASE WHEN t - event <= 60 THEN lang END AS lang FROM a LEFT JOIN w ON w.n = a.n AND r = 1""",
    "op13_manifest": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('v' || lang, '') AS g, {_LEAF.replace('{n}', 'n_chars')} AS leaf, {_LEAF.replace('{n}', '(n_chars + 1)')} AS bad FROM documents),
  o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM d),
  t(g, l, p, h, n) AS (SELECT g, 0, p, leaf, n FROM o UNION ALL SELECT g, l + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, l, n, p // 2),
  s AS (SELECT g, h AS subroot, l AS tall, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM t WHERE n = 1),
  u(l, p, h, n) AS (SELECT 0, p, subroot, n FROM s UNION ALL SELECT l + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY l, n, p // 2),
  r AS (SELECT h AS root, l AS tall FROM u WHERE n = 1),
  k AS (SELECT o.doc_id, o.g, o.p, leaf, subroot, root, s.tall AS low, r.tall AS high, s.p AS q, CASE WHEN crc_7 THEN coalesce(bad, leaf) ELSE leaf END AS f FROM (SELECT *, {_CRC32} % 7 = 0 AS crc_7 FROM o) o JOIN s USING (g), r),
  w(doc_id, p, g, q, l, low, high, f, seen) AS (SELECT doc_id, p, g, q, 0, low, high, f, '' FROM k UNION ALL
    SELECT w.doc_id, w.p, w.g, w.q, w.l + 1, low, high, sha256(CASE WHEN (CASE WHEN w.l < low THEN w.p >> w.l ELSE w.q >> (w.l - low) END) % 2 = 1 THEN coalesce(a.h, b.h, '') || f ELSE f || coalesce(a.h, b.h, '') END), seen || coalesce(a.h, b.h, '')
    FROM w LEFT JOIN t a ON w.l < low AND a.g = w.g AND a.l = w.l AND a.p = xor(w.p >> w.l, 1) LEFT JOIN u b ON w.l >= low AND b.l = w.l - low AND b.p = xor(w.q >> (w.l - low), 1) WHERE w.l < low + high)
  SELECT k.doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, w.f AS folded_root, w.f = root AS verified FROM k JOIN w ON k.g = w.g AND k.p = w.p AND w.l = k.low + k.high""",
}

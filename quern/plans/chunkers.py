"""Queries of chunkers. Documents stand for proposals, papers, code and markdown, conversations for forums and transcripts; blank lines part their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chunkers as C
from quern.operators.chunking import flags
from quern.plans.catalog import register, spread, table
from quern.plans.knowledge import _POSTS, _PROPOSALS, posts, proposals

_TOKENS = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+'))"


def greedy(items: str, name: str, most: int, first: str = "0") -> str:
    """Chunk numbers c of items (k, i from 1, n): a fold along i, in SQL."""
    return f"""{name} AS (SELECT k, i, n, 0 AS c, {first} + n AS used FROM {items} WHERE i = 1 UNION ALL SELECT t.k, t.i, t.n, CASE WHEN g.used + t.n > {most} THEN g.c + 1 ELSE g.c END, CASE WHEN g.used + t.n > {most} THEN t.n ELSE g.used + t.n END FROM {name} g JOIN {items} t ON t.k = g.k AND t.i = g.i + 1)"""


def parted(source: str, text: str) -> str:
    """Paragraphs (k, i, p, n) of a text column."""
    return f"SELECT k, i, l[i] AS p, {_TOKENS.format('l[i]')} AS n FROM (SELECT k, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT k, string_split(regexp_replace({text}, '\\n\\n+', chr(1), 'g'), chr(1)) AS l FROM {source}))"


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _spaced(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))


_SPACED = "d AS (SELECT doc_id AS k, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE text IS NOT NULL)"
_CODE = "```\ncode of {}\n```"


def _as_proposals(spark, d):
    """One section of a document's lines and, for some, a code block in the middle; then a short one."""
    t = F.col("t")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(t, F.lit("\n\n```\ncode of "), "doc_id", F.lit("\n```\n\nafter that"))).otherwise(t)
    sections = F.array(F.struct(F.lit("Motivation").alias("name"), body.alias("content")), F.struct(F.lit("End").alias("name"), F.lit("short end").alias("content")))
    p = proposals(spark, d).withColumn("requires", F.when(F.col("number") % 4 == 0, F.array((F.col("number") + 1).cast("int"))))
    p = p.select(F.col("number").alias("_n"), "title", "status", "type", "category", F.lit(None).cast("string").alias("author"), F.lit("2020-01-01").alias("created"), "requires")
    rows = _spaced(spark, d).select("doc_id", sections.alias("sections"))
    return rows.join(p, F.col("doc_id") == F.col("_n")).withColumn("number", F.col("doc_id"))


_PACKED = "SELECT k, c, sum(n)::INTEGER AS token_count, string_agg(p, chr(10) || chr(10) ORDER BY i) AS content FROM {} GROUP BY k, c"
register(
    "chk_proposals",
    lambda s, d: C.proposals(_as_proposals(s, d), "doc_id", 64).select("doc_id", "chunk_index", "section", "token_count", F.md5("content").alias("hash")),
    f"""WITH RECURSIVE {_SPACED}, {_PROPOSALS}, p AS (SELECT d.k, d.t, props.*, CASE WHEN k % 3 = 0 THEN t || chr(10) || chr(10) ELSE t END AS body FROM d JOIN props ON number = k), head AS (SELECT k, '# EIP-' || k || ': ' || title || chr(10) || chr(10) || '**Status**: ' || status || chr(10) || '**Type**: ' || type || chr(10) || '**Category**: ' || category || chr(10) || '**Created**: 2020-01-01' || CASE WHEN k % 4 = 0 THEN chr(10) || '**Requires**: EIP-' || (k + 1) ELSE '' END AS content FROM p),
  whole AS (SELECT k, 1 AS part, 0 AS c, {_TOKENS.format('body')} AS token_count, trim(body, {_TRIM}) AS content FROM p WHERE {_TOKENS.format('body')} <= 64 AND trim(body, {_TRIM}) <> ''), items AS ({parted(f"(SELECT * FROM p WHERE {_TOKENS.format('body')} > 64)", 'body')}), {greedy('items', 'g', 64)},
  packed AS ({_PACKED.format('(SELECT g.*, p FROM g JOIN items USING (k, i))')}), parts AS (SELECT k, 0 AS part, 0 AS c, 'Header' AS section, {_TOKENS.format('content')} AS token_count, content FROM head UNION ALL SELECT k, part, c, 'Motivation', token_count, content FROM whole UNION ALL SELECT k, 1, c, 'Motivation', token_count, content FROM packed
  UNION ALL SELECT k, 2, 0, 'Motivation', 2, 'after that' FROM p WHERE k % 3 = 0 UNION ALL SELECT k, 3, 0, 'Motivation > Code Block 1', 6 + {_TOKENS.format('k::VARCHAR')}, '**Motivation - Code Block 1**' || chr(10) || chr(10) || '```' || chr(10) || 'code of ' || k || chr(10) || '```' FROM p WHERE k % 3 = 0 UNION ALL SELECT k, 4, 0, 'End', 2, 'short end' FROM p)
  SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY part, c) - 1)::INTEGER AS chunk_index, section, token_count::INTEGER AS token_count, md5(content) AS hash FROM parts""",
)


def _as_posts(spark, d):
    p = posts(spark, d)
    body = F.concat("content", F.lit("\n\n"), F.repeat(F.lit("a few more words of this post\n\n"), 8))
    return p.select(F.concat_ws("#", "topic_id", "post_number").alias("post"), "post_number", "username", "reply_to", F.lit("2024-01-01 00:00 UTC").alias("created_at"), F.when(F.col("topic_id") % 2 == 0, body).otherwise(F.col("content")).alias("content"))


register(
    "chk_forum_posts",
    lambda s, d: C.posts(_as_posts(s, d), "post", 48).select("post", "chunk_index", "section", "token_count", F.md5("content").alias("hash")),
    f"""WITH RECURSIVE {_POSTS}, x AS (SELECT topic_id || '#' || post_number AS k, post_number, '## Post #' || post_number || ' by @' || username || CASE WHEN reply_to > 0 THEN chr(10) || '*Replying to Post #' || reply_to || '*' ELSE '' END || chr(10) || '*2024-01-01 00:00 UTC*' AS head, CASE WHEN topic_id % 2 = 0 THEN content || chr(10) || chr(10) || repeat('a few more words of this post' || chr(10) || chr(10), 8) ELSE content END AS body FROM posts),
  y AS (SELECT *, {_TOKENS.format('head')} AS h, {_TOKENS.format('body')} AS b FROM x), one AS (SELECT k, post_number, 0 AS c, h + b AS token_count, CASE WHEN h + b <= 48 THEN head || chr(10) || chr(10) || body END AS content FROM y WHERE h + b <= 48),
  long AS (SELECT * FROM y WHERE h + b > 48), items AS (SELECT i.*, h FROM ({parted('long', 'body')}) i JOIN long USING (k)), {greedy('items', 'g', 48, 'h')}, packed AS (SELECT k, c, sum(n) AS token_count, string_agg(p, chr(10) || chr(10) ORDER BY i) AS content FROM (SELECT g.*, p FROM g JOIN items USING (k, i)) GROUP BY k, c)
  SELECT k AS post, c::INTEGER AS chunk_index, 'Post #' || post_number AS section, token_count::INTEGER AS token_count, md5(content) AS hash FROM one UNION ALL SELECT k, c::INTEGER, 'Post #' || post_number, (token_count + CASE WHEN c = 0 THEN h ELSE 0 END)::INTEGER, md5(CASE WHEN c = 0 THEN head || chr(10) || chr(10) ELSE '' END || content) FROM packed JOIN long USING (k)""",
)
register(
    "chk_topic_headers",
    lambda s, d: C.topic_header(table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("posts_count")).select("conv_id", F.concat(F.lit("On "), "conv_id").alias("title"), F.lit("forum").alias("source"), F.when(F.col("conv_id") % 2 == 0, "core").otherwise("").alias("category"), F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tags"), "posts_count", F.when(F.col("conv_id") % 5 == 0, None).otherwise("2024-01-01").alias("created_at")), "conv_id"),
    "SELECT conv_id, '# On ' || conv_id || chr(10) || chr(10) || '**Forum**: forum' || chr(10) || '**Topic ID**: ' || conv_id || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '**Category**: core' ELSE '' END || CASE WHEN conv_id % 3 = 0 THEN chr(10) || '**Tags**: a, b' ELSE '' END || chr(10) || '**Posts**: ' || count(*) || chr(10) || '**Created**: ' || CASE WHEN conv_id % 5 = 0 THEN 'Unknown' ELSE '2024-01-01' END AS content FROM conversations GROUP BY conv_id",
)


def _as_papers(spark, d):
    """Runs of ten words as paragraphs, some with equations or figures; the first line is the abstract."""
    w = F.col("w")
    n = F.floor((F.size(w) + 9) / 10).cast("int")
    parts = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.array_join(F.slice(w, i * 10 + 1, F.lit(10)), " "), F.when(i % 4 == 1, F.lit(" $x$")).when(i % 4 == 2, F.lit(" Table 3")).otherwise(F.lit(""))))
    sections = F.array(F.struct(F.lit("ABSTRACT").alias("heading"), F.substring_index("text", "\n", 1).alias("content")), F.struct(F.lit("Body").alias("heading"), F.array_join(parts, "\n\n").alias("content")))
    # the words are a column of their own: inside a lambda function their expression would be evaluated for every run
    rows = spread(table(spark, d, "documents").where("text IS NOT NULL")).select("doc_id", "text", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    return rows.select("doc_id", F.concat(F.lit("Paper "), "doc_id").alias("title"), F.when(F.col("doc_id") % 2 == 0, "A. Author").alias("author"), sections.alias("sections"))


register(
    "chk_papers",
    lambda s, d: C.papers(_as_papers(s, d), "doc_id", 80).select("doc_id", "chunk_index", "section", "token_count", "has_equations", "has_figures", F.md5("content").alias("hash")),
    f"""WITH RECURSIVE w AS (SELECT doc_id AS k, text, regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0b]+') AS w FROM documents WHERE text IS NOT NULL), items AS (SELECT k, i, p, {_TOKENS.format('p')} AS n FROM (SELECT k, j AS i, array_to_string(w[(j - 1) * 10 + 1:j * 10], ' ') || CASE (j - 1) % 4 WHEN 1 THEN ' $x$' WHEN 2 THEN ' Table 3' ELSE '' END AS p FROM (SELECT k, w, unnest(range(1, (len(w) + 9) // 10 + 1)) AS j FROM w))),
  total AS (SELECT k, sum(n) AS n FROM items GROUP BY k), {greedy('items', 'g', 79)}, c AS (SELECT k, CASE WHEN total.n <= 79 THEN 0 ELSE c END AS c, i, p FROM g JOIN items USING (k, i) JOIN total USING (k)), body AS (SELECT k, c, string_agg(p, chr(10) || chr(10) ORDER BY i) AS p FROM c GROUP BY k, c),
  a AS (SELECT k, string_split(text, chr(10))[1] AS a FROM w), head AS (SELECT k, '# Paper ' || k || CASE WHEN k % 2 = 0 THEN chr(10) || chr(10) || '**Authors:** A. Author' ELSE '' END || CASE WHEN a <> '' THEN chr(10) || chr(10) || '**Abstract:** ' || left(a, 500) ELSE '' END || CASE WHEN length(a) > 500 THEN chr(10) || '...' ELSE '' END AS content FROM a)
  SELECT k AS doc_id, 0::INTEGER AS chunk_index, 'Header' AS section, {_TOKENS.format('content')}::INTEGER AS token_count, false AS has_equations, false AS has_figures, md5(content) AS hash FROM head
  UNION ALL SELECT k, (c + 1)::INTEGER, 'Body', ({_TOKENS.format('p')} + 1)::INTEGER, contains(p, '$x$') OR regexp_matches(p, '(?s)\\$[^$]+\\$|=\\s*\\d+'), regexp_matches(p, '(?i)(Figure|Table)\\s+\\d+|Fig\\.\\s*\\d+'), md5('## Body' || chr(10) || chr(10) || p) FROM body WHERE trim(p, {_TRIM}) <> ''""",
)


def _as_transcripts(spark, d):
    """Conversations as transcripts; every seventh turn is very long, every second has a time."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("r"))
    long = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.concat(F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.concat(F.lit("w"), i)), " "))).otherwise("")
    s = F.struct("turn", F.col("r.role").alias("speaker"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("00:0"), F.col("turn") % 10)).alias("time"), F.concat(F.coalesce("r.text", F.lit("")), long).alias("text"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(s)).alias("s"))
    return rows.select("conv_id", F.col("conv_id").alias("call_number"), F.transform("s", lambda x: F.struct(x["speaker"].alias("speaker"), x["time"].alias("time"), x["text"].alias("text"))).alias("segments"))


register(
    "chk_transcripts",
    lambda s, d: C.transcripts(_as_transcripts(s, d), "conv_id", 96, 8).select("conv_id", "chunk_index", "speaker", "time_start", "time_end", "segments", F.when(F.col("segments") > 0, F.md5("content")).alias("hash"), F.regexp_count("content", F.lit(r"continued")).alias("marks")),
    f"""WITH RECURSIVE c AS (SELECT conv_id, turn, min({{'role': role, 'text': text}}) AS r FROM conversations GROUP BY ALL), s AS (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, r.role AS speaker, CASE WHEN turn % 2 = 0 THEN '00:0' || (turn % 10) END AS time, coalesce(r.text, '') || CASE WHEN (conv_id + turn) % 7 = 0 THEN ' ' || array_to_string(list_transform(range(1, 151), lambda x: 'w' || x), ' ') ELSE '' END AS text FROM c),
  items AS (SELECT *, '**' || speaker || ':**' || CASE WHEN time IS NOT NULL THEN ' [' || time || ']' ELSE '' END || ' ' || text AS line, {_TOKENS.format('text')} AS m FROM s), x AS (SELECT *, {_TOKENS.format('line')} AS n, 1 + greatest(0, CAST(ceil((m - 8) / 38) AS BIGINT) - 1) AS w FROM items),
  g AS (SELECT k, i, n, CASE WHEN n > 96 THEN 0 ELSE 0 END AS c, CASE WHEN n > 96 THEN w ELSE 0 END AS next, CASE WHEN n > 96 THEN 0 ELSE n END AS used, n <= 96 AS open FROM x WHERE i = 1
   UNION ALL SELECT x.k, x.i, x.n, CASE WHEN x.n > 96 OR (g.open AND g.used + x.n > 96) THEN g.next + g.open::INTEGER ELSE g.next END, CASE WHEN x.n > 96 THEN g.next + g.open::INTEGER + x.w WHEN g.open AND g.used + x.n > 96 THEN g.next + 1 ELSE g.next END, CASE WHEN x.n > 96 THEN 0 WHEN g.open AND g.used + x.n <= 96 THEN g.used + x.n ELSE x.n END, x.n <= 96 FROM g JOIN x ON x.k = g.k AND x.i = g.i + 1),
  j AS (SELECT g.c, x.* FROM g JOIN x USING (k, i)), packed AS (SELECT k, c, CASE WHEN count(*) = 1 THEN min(speaker) END AS speaker, arg_min(time, i) FILTER (time IS NOT NULL) AS a, arg_max(time, i) FILTER (time IS NOT NULL) AS b, count(*) AS segments, string_agg(line, chr(10) || chr(10) ORDER BY i) AS t FROM j WHERE n <= 96 GROUP BY k, c)
  SELECT k AS conv_id, c::INTEGER AS chunk_index, speaker, a AS time_start, b AS time_end, segments::INTEGER AS segments, md5('[ACD Call #' || k || ']' || CASE WHEN a IS NOT NULL THEN ' [' || a || CASE WHEN b <> a THEN ' - ' || b ELSE '' END || ']' ELSE '' END || chr(10) || chr(10) || t) AS hash, len(regexp_extract_all(t, 'continued'))::INTEGER AS marks FROM packed
  UNION ALL SELECT k, (c + u)::INTEGER, speaker, time, time, 0, NULL, ((u > 0)::INTEGER + (u * 38 + 46 < m)::INTEGER)::INTEGER FROM (SELECT *, unnest(range(0, w)) AS u FROM j WHERE n > 96)""",
)


def _as_code(spark, d):
    head = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("func "), F.repeat(F.lit("very "), 30), F.lit("long(x) {"))).otherwise(F.concat(F.lit("func f"), "doc_id", F.lit("(x) {")))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("name"), F.concat_ws("\n", head, F.translate("text", "{}", "()"), F.lit("}")).alias("content"))


register(
    "chk_code",
    lambda s, d: C.code(_as_code(s, d), "doc_id", 72).select("doc_id", "chunk_index", "name", "token_count", F.md5("content").alias("hash")),
    f"""WITH RECURSIVE u AS (SELECT doc_id AS k, CASE WHEN doc_id % 10 = 0 THEN 'func ' || repeat('very ', 30) || 'long(x) {{' ELSE 'func f' || doc_id || '(x) {{' END AS head, replace(replace(text, '{{', '('), '}}', ')') || chr(10) || '}}' AS body FROM documents WHERE text IS NOT NULL), v AS (SELECT *, head || chr(10) || body AS content, {_TOKENS.format("head || ' ' || body")} AS n FROM u),
  items AS (SELECT k, i, l[i] AS p, {_TOKENS.format('l[i]')} AS n FROM (SELECT k, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT k, string_split(body, chr(10)) AS l FROM v WHERE n > 72 AND k % 10 > 0))), {greedy('items', 'g', 59)}, b AS (SELECT k, c, string_agg(p, chr(10) ORDER BY i) AS p, max(c) OVER (PARTITION BY k) AS last FROM g JOIN items USING (k, i) GROUP BY k, c),
  t AS (SELECT k, c, last, CASE WHEN last > 0 AND c = last THEN '// ... continued from previous chunk' || chr(10) ELSE '' END || head || chr(10) || p || CASE WHEN c < last THEN chr(10) || '    // ... continued' ELSE '' END AS t FROM b JOIN v USING (k))
  SELECT k AS doc_id, 0::INTEGER AS chunk_index, 'f' || k AS name, n::INTEGER AS token_count, md5(content) AS hash FROM v WHERE n <= 72 UNION ALL SELECT k, 0, 'f' || k, {_TOKENS.format('left(content, 288)')}::INTEGER, md5(left(content, 288) || chr(10) || '// ... truncated') FROM v WHERE n > 72 AND k % 10 = 0
  UNION ALL SELECT k, c::INTEGER, 'f' || k || CASE WHEN last > 0 THEN '_part' || (c + 1) ELSE '' END, {_TOKENS.format('t')}::INTEGER, md5(t) FROM t""",
)


def _in_context(spark, d):
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("lines"))
    at = F.least(F.lit(3), F.size("lines"))
    units = lines.select("doc_id", "lines", at.alias("start_line"), F.least(F.lit(5), F.size("lines")).alias("end_line"))
    return units.withColumn("content", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))


register(
    "chk_code_in_context",
    lambda s, d: C.code_in_context(_in_context(s, d), 2, 120).select("doc_id", "token_count", F.md5("content").alias("hash")),
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, l, least(3, len(l)) AS a, least(5, len(l)) AS b FROM l), p AS (SELECT doc_id, array_to_string(l[a:b], chr(10)) AS c, l[greatest(a - 2, 1):a - 1] AS x, l[b + 1:b + 2] AS y FROM u),
  w AS (SELECT doc_id, c, CASE WHEN len(x) > 0 THEN '// Context before (' || len(x) || ' lines):' || chr(10) || array_to_string(x, chr(10)) || chr(10) || chr(10) ELSE '' END || c || CASE WHEN len(y) > 0 THEN chr(10) || chr(10) || '// Context after (' || len(y) || ' lines):' || chr(10) || array_to_string(y, chr(10)) ELSE '' END AS w FROM p)
  SELECT doc_id, CASE WHEN {_TOKENS.format('w')} <= 120 THEN {_TOKENS.format('w')} ELSE {_TOKENS.format('c')} END::INTEGER AS token_count, md5(CASE WHEN {_TOKENS.format('w')} <= 120 THEN w ELSE c END) AS hash FROM w""",
)


def _as_markdown(spark, d):
    """The first line, then the others below a heading."""
    lines = F.split("text", "\n")
    rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n\n")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(lines[0], F.lit("\n## Part "), "doc_id", F.lit("\n"), rest).alias("text"))


_BODIES = f"""m AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), parts AS (SELECT doc_id, 0 AS s, 'Introduction' AS section, trim(l[1], {_TRIM}) AS t FROM m UNION ALL SELECT doc_id, 1, 'Part ' || doc_id, trim('## Part ' || doc_id || chr(10) || chr(10) || chr(10) || array_to_string(l[2:], chr(10) || chr(10)), {_TRIM}) FROM m),
  bodies AS (SELECT doc_id || '/' || s AS k, doc_id, s, section, t, {_TOKENS.format('t')} AS n FROM parts WHERE t <> '')"""
register(
    "chk_markdown",
    lambda s, d: C.markdown(_as_markdown(s, d), "doc_id", "text", 64).select("doc_id", "chunk_index", "section", "token_count", "chunk_id"),
    f"""WITH RECURSIVE {_BODIES}, items AS ({parted('(SELECT * FROM bodies WHERE n > 64)', 't')}), {greedy('items', 'g', 64)}, packed AS (SELECT k, c, sum(n) AS token_count, trim(string_agg(p, chr(10) || chr(10) ORDER BY i), {_TRIM}) AS content FROM (SELECT g.*, p FROM g JOIN items USING (k, i)) GROUP BY k, c),
  a AS (SELECT doc_id, s, section, 0 AS c, n AS token_count, t AS content FROM bodies WHERE n <= 64 UNION ALL SELECT doc_id, s, section, c, token_count, content FROM packed JOIN bodies USING (k)), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, c) - 1 AS j FROM a)
  SELECT doc_id, j::INTEGER AS chunk_index, section, token_count::INTEGER AS token_count, left(sha256(doc_id || '-' || j || '-' || content), 16) AS chunk_id FROM b""",
)
register(
    "chk_embedding_batches",
    lambda s, d: C.batched(table(s, d, "conversations").distinct(), "conv_id", ["turn", "role"], "text", 60, 3),
    """WITH RECURSIVE d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations), x AS (SELECT conv_id AS k, turn, role, length(coalesce(text, '')) // 4 + 1 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i FROM d),
  g AS (SELECT k, i, 0 AS c, n AS used, 1 AS held FROM x WHERE i = 1 UNION ALL SELECT x.k, x.i, CASE WHEN g.used + x.n > 60 OR g.held >= 3 THEN g.c + 1 ELSE g.c END, CASE WHEN g.used + x.n > 60 OR g.held >= 3 THEN x.n ELSE g.used + x.n END, CASE WHEN g.used + x.n > 60 OR g.held >= 3 THEN 1 ELSE g.held + 1 END FROM g JOIN x ON x.k = g.k AND x.i = g.i + 1)
  SELECT k AS conv_id, turn, role, n::INTEGER AS tokens, c::INTEGER AS batch FROM g JOIN x USING (k, i)""",
)


def _functions(spark, d):
    n = F.col("p_partkey")
    receiver = F.when(n % 3 == 0, F.concat(F.lit("(s *S) f"), n)).otherwise(F.concat(F.lit("f"), n))
    imports = F.array(F.lit("a/fmt"), F.lit("std::vec"), F.lit("os"))
    body = F.concat(F.lit("{ "), F.when(n % 2 == 0, "fmt.Println(x) ").otherwise("vec::new() "), F.when(n % 5 == 0, "os.Exit()").otherwise(""), F.lit(" }"))
    return table(spark, d, "part").select(F.concat(F.lit("src/"), n).alias("path"), F.element_at(F.array(F.lit("go"), F.lit("rust"), F.lit("c")), (n % 3 + 1).cast("int")).alias("language"), F.concat(F.lit("f"), n).alias("name"), F.concat(receiver, F.lit("(x int)")).alias("signature"), body.alias("body"), F.when(n % 4 == 0, "does it\nwell").alias("docstring"), imports.alias("imports"))


register(
    "chk_function_units",
    lambda s, d: C.function_units(_functions(s, d).where("language <> 'c' OR docstring IS NULL")).withColumn("dependencies", F.array_join("dependencies", ",")),
    """WITH f AS (SELECT p_partkey AS n, (['go', 'rust', 'c'])[p_partkey % 3 + 1] AS language FROM part) SELECT 'src/' || n AS path, 'f' || n AS name, CASE WHEN n % 3 = 0 THEN 'method' ELSE 'function' END AS kind,
  CASE WHEN n % 4 = 0 THEN CASE language WHEN 'go' THEN '// does it' || chr(10) || '// well' ELSE '/// does it' || chr(10) || '/// well' END || chr(10) ELSE '' END || CASE language WHEN 'go' THEN 'func ' WHEN 'rust' THEN 'fn ' ELSE '' END || CASE WHEN n % 3 = 0 THEN '(s *S) f' ELSE 'f' END || n || '(x int) { ' || CASE WHEN n % 2 = 0 THEN 'fmt.Println(x) ' ELSE 'vec::new() ' END || CASE WHEN n % 5 = 0 THEN 'os.Exit()' ELSE '' END || ' }' AS content,
  CASE WHEN n % 2 = 0 THEN 'a/fmt' ELSE 'std::vec' END || CASE WHEN n % 5 = 0 THEN ',os' ELSE '' END AS dependencies FROM f WHERE language <> 'c' OR n % 4 > 0""",
)
_TYPES = ("*Block", "[]byte", "Option<Hash>", "uint64", "&Vec<Tx>", " String ", "Map[K]V", "Arc<u8>", "()")


def _structs(spark, d):
    n = F.col("p_partkey")
    kind = lambda k: F.element_at(F.array(*map(F.lit, _TYPES)), ((n + k) % len(_TYPES) + 1).cast("int"))
    fields = F.array(F.struct(F.lit("a").alias("name"), kind(0).alias("kind")), F.struct(F.lit("b").alias("name"), kind(2).alias("kind")))
    return table(spark, d, "part").select(F.concat(F.lit("src/"), n).alias("path"), F.when(n % 2 == 0, "go").otherwise("rust").alias("language"), F.concat(F.lit("T"), n).alias("name"), fields.alias("fields"))


_CLEAN = {"*Block": "Block", "[]byte": None, "Option<Hash>": "Hash", "uint64": None, "&Vec<Tx>": "Tx", " String ": None, "Map[K]V": "Map[K]V", "Arc<u8>": None, "()": None}
register(
    "chk_struct_units",
    lambda s, d: C.struct_units(_structs(s, d)).withColumn("dependencies", F.array_join("dependencies", ",")),
    f"""WITH t AS (SELECT p_partkey AS n, ({list(_TYPES)})[p_partkey % 9 + 1] AS a, ({list(_TYPES)})[(p_partkey + 2) % 9 + 1] AS b FROM part), c(k, v) AS (VALUES {', '.join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in _CLEAN.items())})
  SELECT 'src/' || n AS path, 'T' || n AS name, 'struct' AS kind, CASE WHEN n % 2 = 0 THEN 'type T' || n || ' struct {{' || chr(10) || '    a ' || a || chr(10) || '    b ' || b || chr(10) || '}}' ELSE 'struct T' || n || ' {{' || chr(10) || '    a: ' || a || ',' || chr(10) || '    b: ' || b || ',' || chr(10) || '}}' END AS content, array_to_string(list_filter([x.v, y.v], lambda z: z IS NOT NULL), ',') AS dependencies FROM t JOIN c x ON x.k = a JOIN c y ON y.k = b""",
)


def _bodies(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("src/"), "doc_id").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit(" T"), (F.col("doc_id") % 40).cast("string"), F.lit(" uses T")).alias("body"))


register(
    "chk_unit_references",
    lambda s, d: C.references(_structs(s, d).where("path <> 'src/0'"), _bodies(s, d)),
    "WITH u AS (SELECT 'src/' || p_partkey AS path, 'T' || p_partkey AS name FROM part WHERE p_partkey > 0), b AS (SELECT 'src/' || doc_id AS path, coalesce(text, '') || ' T' || (doc_id % 40) || ' uses T' AS body FROM documents) SELECT DISTINCT u.path, name, b.path AS referenced_in FROM u JOIN b ON contains(body, name) AND u.path <> b.path",
)


def _flagged(spark, d):
    rows = _as_papers(spark, d).select("doc_id", F.col("sections")[1]["content"].alias("t"))
    equations, figures = flags(F.col("t"))
    return rows.select("doc_id", equations.alias("has_equations"), figures.alias("has_figures"))


register(
    "chk_flags",
    _flagged,
    """WITH w AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^ \\t\\n\\f\\r\\x0b]+')) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n > 10 OR regexp_matches(text, '\\$[^$]+\\$|=\\s*\\d+') AS has_equations, n > 20 OR regexp_matches(text, '(?i)(figure|table)\\s+\\d+|fig\\.\\s*\\d+') AS has_figures FROM w""",
)

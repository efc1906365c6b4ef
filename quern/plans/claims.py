"""Queries of located matches, aliases, claims and their evidence, argument maps, quality and confidence parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scoring as S
from quern.functions import text as T
from quern.operators import claims as C
from quern.operators import located as L
from quern.operators import structured as ST
from quern.plans.catalog import register, table
from quern.plans.phrases import sql_sum

#: {a}, {b} numbers, {d} a date
NOTES = (
    'EIP-{a} (proto-danksharding), also known as "blob space", was proposed on {d}. It is sometimes referred to as sharding lite, and on March 5, 2022 it moved. See EIP-{b} (the cap) and EIP-7.',
    "The Account Abstraction (AA) design, commonly called smart wallets, shipped 4 March 2021 or Q3 2022; 2021/03/04 and 1850 too. A benefit: cheaper data for every single user. The risk of higher fees for small nodes remains.",
    "| a | b |\n| c | d |\n```\ncode 2020\n```\n EIP {a} and eip{b} (aka old one) (a.k.a. new thing) nicknamed speedy. It improves the finality of blocks by one epoch.",
    "Nothing here in 2019, dubbed plain talk. Dubbed it. EIP-{a}(1234) EIP-{a} (x) EIP-{a} (Proto-Danksharding). Against: the state grows without any bound at all.",
    "Some argue that EIP-{a} allows rollups to post data, and others that it does not. Con: too complex for the clients. The issue with EIP-{b} and ERC-{b} is its age; EIP-{a} is a standard.",
    "{d} {d} january 3 2020 and EIP-{b}, EIP-{b}. A problem is that nobody ever reads the long text.",
)


def noted(spark, d):
    """(o_orderkey, number, text): notes about the orders' numbers."""
    text = F.element_at(F.array(*map(F.lit, NOTES)), (F.col("o_orderkey") % len(NOTES) + 1).cast("int"))
    for mark, value in (("{a}", (F.col("o_orderkey") % 97).cast("string")), ("{b}", (F.col("o_custkey") % 89).cast("string")), ("{d}", F.col("o_orderdate").cast("date").cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).alias("number"), text.alias("text"))


def _literal(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


NOTED = f"notes AS (SELECT o_orderkey, o_orderkey % 97 AS number, replace(replace(replace(([{', '.join(map(_literal, NOTES))}])[o_orderkey % {len(NOTES)} + 1], '{{a}}', (o_orderkey % 97)::VARCHAR), '{{b}}', (o_custkey % 89)::VARCHAR), '{{d}}', o_orderdate::DATE::VARCHAR) AS text FROM orders)"


def located_sql(key: str, source: str, patterns: tuple[str, ...], group: int = 1, flags: str = "(?i)") -> str:
    """(key, pattern, n, found, start, end, t) of all matches: lengths of what lies before each match, summed."""
    parts = []
    for j, p in enumerate(patterns):
        p = _literal(flags + p)
        parts.append(
            f"SELECT {key}, {j} AS pattern, n - 1 AS n, g[n] AS found, coalesce(list_sum(list_transform(s[1:n], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:n - 1], lambda x: length(x))), 0) AS start, length(f[n]) AS size, t FROM (SELECT *, unnest(range(1, len(f) + 1)) AS n FROM "
            f"(SELECT {key}, text AS t, regexp_extract_all(text, {p}) AS f, regexp_extract_all(text, {p}, {group}) AS g, regexp_split_to_array(text, {p}) AS s FROM {source}))"
        )
    return f"SELECT {key}, pattern::INTEGER AS pattern, n::INTEGER AS n, found, start::INTEGER AS start, (start + size)::INTEGER AS \"end\", t FROM ({' UNION ALL '.join(parts)})"


register(
    "clm_dates_in_context",
    lambda s, d: L.dated(noted(s, d), "o_orderkey"),
    f'WITH {NOTED}, l AS ({located_sql("o_orderkey", "notes", T.DATES)}) SELECT o_orderkey, pattern, n, found, start, "end", trim(substr(t, greatest(start - 100, 0) + 1, least("end" + 100, length(t)) - greatest(start - 100, 0)), chr(10) || \' \') AS context FROM l',
)
register(
    "clm_mentions_in_context",
    lambda s, d: L.mentions(noted(s, d), "o_orderkey", around=40),
    f"""WITH {NOTED}, l AS ({located_sql("o_orderkey", "notes", (L.MENTION,))}) SELECT o_orderkey, n, found::BIGINT AS number, CASE WHEN start > 40 THEN '...' ELSE '' END || trim(regexp_replace(substr(t, greatest(start - 40, 0) + 1, least("end" + 40, length(t)) - greatest(start - 40, 0)), '\\s+', ' ', 'g'), ' ') || CASE WHEN "end" + 40 < length(t) THEN '...' ELSE '' END AS context FROM l""",
)
_CANDIDATES = [f"SELECT o_orderkey, number, 0 AS rule, i * 2 AS n, trim(b[i]) AS alias, 'eip_parenthetical' AS kind FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '(?i){L.PARENTHETICAL}', 1) AS a, regexp_extract_all(text, '(?i){L.PARENTHETICAL}', 2) AS b FROM notes)) WHERE a[i]::BIGINT = number"]
_CANDIDATES += [f"SELECT o_orderkey, number, {j}, i * 2, trim(a[i]), '{kind}' FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, {_literal('(?i)' + p)}, 1) AS a FROM notes))" for j, (p, kind) in enumerate(L.ALIASES, 1)]
_CANDIDATES += [f"SELECT o_orderkey, number, 9, i * 2 + {g}, CASE {g} WHEN 0 THEN a[i] ELSE b[i] END, 'acronym_definition' FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '{L.ACRONYM}', 1) AS a, regexp_extract_all(text, '{L.ACRONYM}', 2) AS b FROM notes)) WHERE length(b[i]) <= 8 AND len(string_split(a[i], ' ')) >= length(b[i])" for g in (0, 1)]
_ALIASES = f"""c AS ({' UNION ALL '.join(_CANDIDATES)}), v AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, lower(alias) ORDER BY rule, n) AS k FROM c WHERE rule = 9 OR (length(alias) BETWEEN 2 AND 100 AND NOT regexp_full_match(alias, '[\\d\\s]+') AND lower(alias) NOT IN ({', '.join(map(_literal, L.NO_ALIAS))}) AND NOT regexp_matches(lower(alias), '^(see |note |i\\.e\\.|e\\.g\\.)'))),
  aliased AS (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY rule, n) - 1)::INTEGER AS n, 'EIP-' || number AS canonical, alias, kind FROM v WHERE k = 1)"""
register("clm_aliases", lambda s, d: L.aliases(noted(s, d), "o_orderkey").drop("context"), f"WITH {NOTED}, {_ALIASES} SELECT * FROM aliased")
register(
    "clm_other_references",
    lambda s, d: L.other_references(noted(s, d), "o_orderkey").drop("n"),
    f"""WITH {NOTED}, r AS (SELECT o_orderkey, number, 0 AS rule, i, a[i]::BIGINT AS other, trim(b[i]) AS context FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '(?i){L.PARENTHETICAL}', 1) AS a, regexp_extract_all(text, '(?i){L.PARENTHETICAL}', 2) AS b FROM notes))
  UNION ALL SELECT o_orderkey, number, 1, i, a[i]::BIGINT, NULL FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '(?i)EIP-?(\\d+)', 1) AS a FROM notes)))
  SELECT o_orderkey, other, context FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, other ORDER BY rule, i) AS k FROM r WHERE other <> number) WHERE k = 1""",
)
_STRUCTURAL = f"""SELECT o_orderkey, CASE pattern WHEN 0 THEN 'code' ELSE 'table' END AS kind, n, start, "end" FROM ({located_sql("o_orderkey", "notes", (L.CODE, L.TABLE), 0)})"""
register("clm_structural_spans", lambda s, d: L.structural_spans(noted(s, d), "o_orderkey"), f"WITH {NOTED} {_STRUCTURAL}")
register(
    "clm_positions_inside",
    lambda s, d: L.inside(L.structural_spans(noted(s, d), "o_orderkey"), noted(s, d).select("o_orderkey", F.explode(F.array(F.lit(5), F.lit(25))).alias("position")), "o_orderkey"),
    f"""WITH {NOTED}, p AS (SELECT o_orderkey, unnest([5, 25])::INTEGER AS position FROM notes), s AS ({_STRUCTURAL}) SELECT p.o_orderkey, position, coalesce(bool_or(kind = 'code' AND start <= position AND position < "end"), false) AS in_code, coalesce(bool_or(kind = 'table' AND start <= position AND position < "end"), false) AS in_table FROM p LEFT JOIN s USING (o_orderkey) GROUP BY ALL""",
)


def _paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


_LONG = "d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), l AS (SELECT * FROM d WHERE length(text) > 500)"
_SENTENCES = "s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM l), e AS (SELECT doc_id, text, i, s[i] AS x, len(s) AS n FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s))"
register(
    "clm_candidate_spans",
    lambda s, d: L.candidate_spans(_paragraphs(s, d), "doc_id"),
    f"""WITH RECURSIVE {_LONG}, {_SENTENCES},
  g AS (SELECT doc_id, text, 0::BIGINT AS i, 0::BIGINT AS off, 0::BIGINT AS beginning, 0::BIGINT AS size, NULL::BIGINT AS a, NULL::BIGINT AS b FROM l UNION ALL
   SELECT g.doc_id, g.text, e.i, g.off + length(e.x) + 1, CASE WHEN g.size + length(e.x) > 500 THEN g.off ELSE g.beginning END, CASE WHEN g.size + length(e.x) > 500 THEN 0 ELSE g.size END + length(e.x) + 1,
   CASE WHEN g.size + length(e.x) > 500 THEN g.beginning END, CASE WHEN g.size + length(e.x) > 500 THEN g.size END FROM g JOIN e ON e.doc_id = g.doc_id AND e.i = g.i + 1),
  p AS (SELECT doc_id, text, a, b FROM g WHERE a IS NOT NULL UNION ALL SELECT doc_id, text, arg_max(beginning, i), arg_max(size, i) FROM g GROUP BY doc_id, text),
  q AS (SELECT doc_id, a, length(trim(substr(text, a + 1, b), ' ' || chr(10) || chr(9) || chr(13))) AS n, length(text) AS m FROM p WHERE b > 0),
  w AS (SELECT doc_id, a, least(a + 500, length(text)) AS b, text FROM (SELECT *, unnest(range(0, length(text) - 50, 450)) AS a FROM l)),
  x AS (SELECT doc_id, a, b, CASE WHEN b < length(text) AND contains(substr(text, a + 1, b - a), ' ') THEN a + length(substr(text, a + 1, b - a)) - strpos(reverse(substr(text, a + 1, b - a)), ' ') ELSE -1 END AS blank FROM w),
  y AS (SELECT doc_id, a, CASE WHEN blank > a + 50 THEN blank ELSE b END AS b FROM x),
  z AS (SELECT doc_id, text, parts[j] AS part, list_sum(list_transform(parts[1:j - 1], lambda v: length(v) + 2))::BIGINT AS off FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS parts FROM l))),
  k AS (SELECT doc_id, coalesce(off, 0) + length(part) - length(ltrim(part, ' ' || chr(10) || chr(9) || chr(13))) AS a, length(trim(part, ' ' || chr(10) || chr(9) || chr(13))) AS n FROM z)
  SELECT doc_id, 'whole' AS kind, 0::INTEGER AS start, length(text)::INTEGER AS "end" FROM d WHERE length(text) <= 500 UNION ALL SELECT doc_id, 'sentences', a::INTEGER, least(a + n, m)::INTEGER FROM q WHERE n >= 50
  UNION ALL SELECT doc_id, 'window', a::INTEGER, b::INTEGER FROM y WHERE b - a >= 50 UNION ALL SELECT doc_id, 'paragraph', a::INTEGER, (a + n)::INTEGER FROM k WHERE n BETWEEN 50 AND 500""",
)
register(
    "clm_atomic_facts",
    lambda s, d: C.atomic_facts(noted(s, d), "o_orderkey", "text"),
    f"""WITH {NOTED}, f AS (SELECT o_orderkey, {sql_sum(C.COMPOUND, 'text')} AS k, text, string_split(regexp_replace(text, '(?i)\\s+and\\s+', chr(1), 'g'), chr(1)) AS p FROM notes), g AS (SELECT o_orderkey, k, CASE WHEN k > 0 AND len(p) > 1 THEN list_filter(list_transform(p, lambda x: trim(x, ' ')), lambda x: x <> '') ELSE [text] END AS p FROM f)
  SELECT o_orderkey, j::INTEGER AS n, p[j + 1] AS fact, k >= 2 AS by_model FROM (SELECT *, unnest(range(0, len(p))) AS j FROM g)""",
)


def _answered(spark, d):
    """Answers with markers: notes, each sentence of some cited."""
    cite = F.regexp_replace("text", r"([a-z])\. ", "$1 [1, " + "2]. ")
    return noted(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("text")).otherwise(F.replace(cite, F.lit("2]"), F.concat((F.col("number") % 7).cast("string"), F.lit("]")))).alias("text"))


ANSWERED = f"{NOTED}, answers AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN text ELSE replace(regexp_replace(text, '([a-z])\\. ', '\\1 [1, 2]. ', 'g'), '2]', (number % 7)::VARCHAR || ']') END AS text FROM notes)"
LEDGER = f"""{ANSWERED}, parts AS (SELECT o_orderkey, text, regexp_extract_all(text, '[^.!?]+[.!?]+') AS s FROM answers), each AS (SELECT o_orderkey, text, j AS n, s[j + 1] AS s FROM (SELECT *, unnest(range(0, len(s))) AS j FROM (SELECT o_orderkey, text, CASE WHEN len(s) > 0 THEN s ELSE [text] END AS s FROM parts))),
  plain AS (SELECT o_orderkey, n, trim(regexp_replace(trim(s, ' '), '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', '', 'g'), ' ') AS claim, regexp_extract_all(s, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1) AS m, text FROM each),
  claims AS (SELECT o_orderkey, n::INTEGER AS n, claim, m, CASE WHEN strpos(text, claim) > 0 THEN strpos(text, claim) - 1 END::INTEGER AS start, text FROM plain WHERE trim(claim) <> '')"""


def _ledger(spark, d):
    hits = spark.createDataFrame([(1, "eip-1", "Motivation"), (3, "eip-3", None), (5, "eip-5", "Abstract")], "marker int, document_id string, section string")
    rows = _answered(spark, d)
    return C.ledger(rows, rows.select("o_orderkey").crossJoin(F.broadcast(hits)), "o_orderkey")


_HITS = "(VALUES (1, 'eip-1', 'Motivation'), (3, 'eip-3', NULL), (5, 'eip-5', 'Abstract')) h(marker, document_id, section)"
_MARKERS = "SELECT o_orderkey, n, unnest(flatten(list_transform(m, lambda x: list_transform(regexp_extract_all(x, '\\d+'), lambda y: y::INTEGER)))) AS marker FROM claims"
register("clm_ledger_claims", lambda s, d: _ledger(s, d)[0].drop("markers"), f"WITH {LEDGER} SELECT o_orderkey, n, claim, CASE WHEN len(m) > 0 THEN 'factual' ELSE 'interpretive' END AS kind, start, (start + length(claim))::INTEGER AS \"end\" FROM claims")
register("clm_ledger_evidence", lambda s, d: _ledger(s, d)[1], f"WITH {LEDGER}, k AS ({_MARKERS}) SELECT o_orderkey, n, k.marker, document_id, section FROM k JOIN {_HITS} USING (marker)")
register(
    "clm_claim_levels",
    lambda s, d: C.fact_levels(_levels(s, d)).select("o_orderkey", "n", "level", C.flagged(F.col("level")).alias("flagged")),
    f"WITH {LEDGER}, {{LEVELS}} SELECT o_orderkey, n, level, level IN ('contradiction', 'none', 'weak') AS flagged FROM v".replace("{LEVELS}", "v AS (SELECT o_orderkey, n, claim, start, CASE WHEN e IS NULL THEN 'none' WHEN c > 0.7 THEN 'contradiction' WHEN e > 0.7 THEN 'strong' WHEN e > 0.4 THEN 'partial' ELSE 'weak' END AS level FROM (SELECT *, CASE WHEN (o_orderkey + n) % 6 > 0 THEN ((o_orderkey + 3 * n) % 10) / 10 END AS e, ((o_orderkey + n) % 4) / 4 AS c FROM claims))"),
)


def _levels(spark, d):
    k = F.col("o_orderkey") + F.col("n")
    return _ledger(spark, d)[0].withColumn("entailment", F.when(k % 6 > 0, ((F.col("o_orderkey") + 3 * F.col("n")) % 10) / 10)).withColumn("contradiction", (k % 4) / 4)


LEVELS = "v AS (SELECT o_orderkey, n, claim, start, (start + length(claim))::INTEGER AS stop, text, CASE WHEN e IS NULL THEN 'none' WHEN c > 0.7 THEN 'contradiction' WHEN e > 0.7 THEN 'strong' WHEN e > 0.4 THEN 'partial' ELSE 'weak' END AS level FROM (SELECT *, CASE WHEN (o_orderkey + n) % 6 > 0 THEN ((o_orderkey + 3 * n) % 10) / 10 END AS e, ((o_orderkey + n) % 4) / 4 AS c FROM claims))"


def _edited_sql(edit: str, none: str) -> str:
    """Pieces of an answer between and of its claims, put together again."""
    return f"""o AS (SELECT *, max(stop) OVER (PARTITION BY o_orderkey ORDER BY start, stop, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM v WHERE start IS NOT NULL), f AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY o_orderkey ORDER BY start, stop, n), 0) AS before FROM o WHERE most IS NULL OR start >= most), x AS (SELECT o_orderkey, string_agg(substr(text, before + 1, start - before) || {edit}, '' ORDER BY start, stop) AS t, max(stop) AS stop, count(*) FILTER ({none}) AS k FROM f GROUP BY o_orderkey),
  w AS (SELECT o_orderkey, coalesce(t, '') || substr(text, coalesce(stop, 0) + 1) AS t, coalesce(k, 0)::INTEGER AS k FROM answers LEFT JOIN x USING (o_orderkey))"""


def _checked(spark, d):
    return C.fact_levels(_levels(spark, d)).select("o_orderkey", "n", "claim", "start", "end", "level")


register(
    "clm_verified_response",
    lambda s, d: C.verified(_answered(s, d), _checked(s, d), "o_orderkey"),
    f"""WITH {LEDGER}, {LEVELS}, {_edited_sql("CASE level WHEN 'contradiction' THEN '' WHEN 'none' THEN substr(text, start + 1, stop - start) || ' [unverified]' ELSE substr(text, start + 1, stop - start) END", "level = 'contradiction'")}
  SELECT o_orderkey, regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '\\.\\s*\\.', '.', 'g') AS text, k AS removed FROM w""",
)
_FLAG = "CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.FLAGS.items()) + " ELSE '' END"
_BEFORE, _AFTER = C.NOTICE.split("{}")
register(
    "clm_flagged_response",
    lambda s, d: C.flagged_response(_answered(s, d), _checked(s, d), "o_orderkey"),
    f"""WITH {LEDGER}, {LEVELS}, {_edited_sql(f"substr(text, start + 1, stop - start) || {_FLAG}", "level IN ('contradiction', 'none', 'weak')")} SELECT o_orderkey, t || CASE WHEN k > 0 THEN '{_BEFORE}' || k || '{_AFTER}' ELSE '' END AS text, k AS flagged FROM w""",
)
_MARK = "CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.MARKS.items()) + " END"
register(
    "clm_report",
    lambda s, d: C.report(_checked(s, d), "o_orderkey"),
    f"""WITH {LEDGER}, {LEVELS} SELECT o_orderkey, '# Citation Validation Report' || chr(10) || '- Total claims: ' || count(*) || chr(10) || '- Supported (strong/partial): ' || count(*) FILTER (level IN ('strong', 'partial')) || chr(10) || '- Weakly supported: ' || count(*) FILTER (level = 'weak') || chr(10) || '- Unsupported: ' || count(*) FILTER (level = 'none') || chr(10) || '- Contradicted: ' || count(*) FILTER (level = 'contradiction')
  || chr(10) || chr(10) || string_agg('### ' || {_MARK} || ' claim-' || (n + 1) || chr(10) || '**Claim**: ' || claim || chr(10) || '**Support Level**: ' || level, chr(10) || chr(10) ORDER BY n) AS report FROM v GROUP BY o_orderkey""",
)
register(
    "clm_verification_summary",
    lambda s, d: _checked(s, d).groupBy("o_orderkey").agg(F.count_if(F.col("level") == "contradiction").alias("r"), F.count_if(F.col("level") == "weak").alias("w")).select("o_orderkey", C.verification_summary(F.col("r"), F.col("w")).alias("summary")),
    f"""WITH {LEDGER}, {LEVELS}, g AS (SELECT o_orderkey, count(*) FILTER (level = 'contradiction') AS r, count(*) FILTER (level = 'weak') AS w FROM v GROUP BY o_orderkey) SELECT o_orderkey, CASE WHEN r = 0 AND w = 0 THEN '**Verification**: All claims are supported by cited evidence.' ELSE
  CASE WHEN r > 0 THEN '**Removed Claims (' || r || ')**: Claims contradicted by evidence were removed.' ELSE '' END || CASE WHEN r > 0 AND w > 0 THEN chr(10) ELSE '' END || CASE WHEN w > 0 THEN '**Citation Warnings (' || w || ')**: Some factual claims lack citations.' ELSE '' END END AS summary FROM g""",
)


def _sources(spark, d):
    return table(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("EIP-")).otherwise(F.lit("x/erc-")), (F.col("p_partkey") % 150).cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("-draft")).otherwise(F.lit(""))).alias("document_id")).distinct()


register(
    "clm_citation_suggestions",
    lambda s, d: C.suggestions(noted(s, d), _sources(s, d), "o_orderkey", "text"),
    f"""WITH {NOTED}, s AS (SELECT DISTINCT lower(CASE WHEN p_partkey % 2 = 0 THEN 'EIP-' ELSE 'x/erc-' END || (p_partkey % 150) || CASE WHEN p_partkey % 3 = 0 THEN '-draft' ELSE '' END) AS document_id FROM part),
  w AS (SELECT DISTINCT o_orderkey, unnest(list_concat(list_transform(regexp_extract_all(text, '(?i)EIP-(\\d+)', 1), lambda x: 'eip-' || x), list_transform(regexp_extract_all(text, '(?i)ERC-(\\d+)', 1), lambda x: 'erc-' || x))) AS w FROM notes) SELECT DISTINCT o_orderkey, document_id FROM w JOIN s ON contains(document_id, w)""",
)
_SIDES = [(side, j, p) for side, ps in (("pro", ST.PRO), ("con", ST.CON)) for j, p in enumerate(ps)]
_ARGUMENTS = f"""r AS ({' UNION ALL '.join(f"SELECT o_orderkey, {k} AS rule, i, '{side}' AS side, trim(a[i], ' ') AS claim FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT o_orderkey, regexp_extract_all(text, '(?i){p}', 1) AS a FROM notes))" for k, (side, _, p) in enumerate(_SIDES))}),
  args AS (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY rule, i) - 1)::INTEGER AS n, side, claim, 'moderate' AS strength FROM r WHERE length(claim) > 20)"""
register("clm_argument_positions", lambda s, d: ST.positions(noted(s, d), "o_orderkey"), f"WITH {NOTED}, {_ARGUMENTS} SELECT * FROM args")


def _weighed(spark, d):
    strength = F.element_at(F.array(*map(F.lit, ("weak", "strong", "odd"))), (F.col("n") % 3 + 1))
    return ST.argument_summary(ST.positions(noted(spark, d), "o_orderkey").withColumn("strength", strength), "o_orderkey")


register(
    "clm_argument_summary",
    _weighed,
    f"""WITH {NOTED}, {_ARGUMENTS}, w AS (SELECT *, [1, 3, 2][n % 3 + 1] AS s FROM args) SELECT o_orderkey, count(*) FILTER (side = 'pro') AS pro, count(*) FILTER (side = 'con') AS con, 0::BIGINT AS neutral, arg_max(claim, s * 100 - n) FILTER (side = 'pro') AS best_pro, arg_max(claim, s * 100 - n) FILTER (side = 'con') AS best_con FROM w GROUP BY o_orderkey""",
)


def _quality_parts(spark, d):
    """Documents as extractions: lines as sections, headed by their first words."""
    heads = ("Abstract", "Introduction", "1 Introduction", "Methods", "Conclusion", "References")
    rows = table(spark, d, "documents").where("text IS NOT NULL").withColumn("l", F.split("text", "\n"))
    head = F.array(*map(F.lit, heads))
    sections = F.transform("l", lambda t, i: F.struct(F.element_at(head, ((i * 5 + F.col("doc_id")) % len(heads) + 1).cast("int")).alias("heading"), t.alias("content")))
    title = F.when(F.col("doc_id") % 4 == 0, "Untitled").when(F.col("doc_id") % 4 == 1, "").otherwise("T")
    parts = {"text": S.text_quality(F.col("text")), "structure": S.structure_quality(sections), "completeness": S.completeness(F.length("text"), F.col("doc_id") % 7, F.col("doc_id") % 8, title), "encoding": S.encoding_quality(F.col("text"))}
    rows = rows.select("doc_id", *[F.round(v, 6).alias(k) for k, v in parts.items()])
    cols = [F.col(c) for c in parts]
    overall = F.round(S.overall_quality(*cols), 6)
    return rows.select("doc_id", "structure", "completeness", overall.alias("overall"), S.acceptable(overall).alias("ok"), S.acceptable(overall, 0.5).alias("ok_paper"), F.array_join(S.quality_suggestions(*cols), ",").alias("suggestions"))


def _quality_sql() -> str:
    from quern.plans.catalog import ORACLES

    text, encoding = (ORACLES[n].replace("FROM documents)", "FROM documents WHERE text IS NOT NULL)").replace("CASE doc_id % 5", "CASE -1") for n in ("sco_text_quality", "sco_encoding_quality"))
    heads = "['abstract', 'introduction', '1 introduction', 'methods', 'conclusion', 'references']"
    return f"""WITH q AS ({text}), e AS ({encoding}), l AS (SELECT doc_id, length(text) AS chars, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, chars, l, list_transform(range(0, len(l)), lambda i: {heads}[(i * 5 + doc_id) % 6 + 1]) AS h FROM l),
  s AS (SELECT doc_id, chars, round(greatest(0.0, 1.0 - 0.1 * (4 - list_contains(h, 'abstract')::INTEGER - (list_contains(h, 'introduction') OR list_contains(h, '1 introduction'))::INTEGER - list_contains(h, 'conclusion')::INTEGER - list_contains(h, 'references')::INTEGER) - 0.05 * len(list_filter(l, lambda x: length(trim(x, ' ')) < 50)) - CASE WHEN list_contains(h, 'abstract') AND list_contains(h, 'references') AND list_position(list_reverse(h), 'abstract') < list_position(list_reverse(h), 'references') THEN 0.2 ELSE 0 END), 6)::DOUBLE AS structure,
  round(greatest(0.0, 1.0 - CASE WHEN chars < doc_id % 7 * 500 THEN (1 - chars / (doc_id % 7 * 500)) * 0.3 ELSE 0 END - CASE WHEN doc_id % 8 = 0 THEN 0.1 WHEN doc_id % 8 < 5 THEN 0.05 ELSE 0 END - CASE WHEN doc_id % 4 < 2 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS completeness FROM h),
  o AS (SELECT s.*, q.quality AS t, e.quality AS c, round(0.4::DOUBLE * q.quality + 0.3::DOUBLE * structure + 0.2::DOUBLE * completeness + 0.1::DOUBLE * e.quality, 6) AS overall FROM s JOIN q USING (doc_id) JOIN e USING (doc_id))
  SELECT doc_id, structure, completeness, overall, overall >= 0.6 AS ok, overall >= 0.5 AS ok_paper, CASE WHEN t >= 0.6 AND structure >= 0.6 AND c >= 0.8 AND completeness >= 0.7 THEN 'none_needed' ELSE array_to_string(list_filter([CASE WHEN t < 0.6 THEN 'text_extraction' END, CASE WHEN structure < 0.6 THEN 'structure' END, CASE WHEN c < 0.8 THEN 'encoding' END, CASE WHEN completeness < 0.7 THEN 'completeness' END], lambda x: x IS NOT NULL), ',') END AS suggestions FROM o"""


register("clm_quality_parts", _quality_parts, _quality_sql())
_KINDS = ("eip-{}", "ERC-{}", "execution-specs/{}", "consensus-specs-{}", "ethereum-research-{}", "eth-magicians-{}", "acd-transcript-{}", "arxiv:{}", "note-{}")


def _hits(spark, d):
    doc = F.element_at(F.array(*[F.lit(k.replace("{}", "")) for k in _KINDS]), (F.col("event_id") % len(_KINDS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", "user_id", F.concat(doc, (F.col("event_id") % 40).cast("string")).alias("document_id"), (F.col("value") / 1000).alias("relevance"))


_HITTED = f"h AS (SELECT event_id, user_id, ([{', '.join(_literal(k.replace('{}', '')) for k in _KINDS)}])[event_id % {len(_KINDS)} + 1] || (event_id % 40) AS document_id, value / 1000 AS relevance FROM events)"
_WEIGHT = "CASE " + " ".join(f"WHEN contains(lower(document_id), '{k}') THEN {w}" for k, w in S.AUTHORITY.items()) + " ELSE 0.5 END::DOUBLE"
register("clm_authority", lambda s, d: _hits(s, d).groupBy("user_id").agg(F.round(F.avg(S.authority(F.col("document_id"))), 6).alias("authority")), f"WITH {_HITTED} SELECT user_id, round(avg({_WEIGHT}), 6) AS authority FROM h GROUP BY user_id")


def _assessed(spark, d):
    """Whether a user's hits suffice, and what would help; hits in order of their ids."""
    from pyspark.sql import Window as W

    ranked = _hits(spark, d).withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    g = ranked.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("k") <= 3, F.col("relevance"))).alias("best"), F.round(F.avg("relevance"), 6).alias("relevance"), F.round(F.avg(S.authority(F.col("document_id"))), 6).alias("authority"), F.countDistinct("document_id").alias("docs"))
    spread = F.round(S.diversity(F.col("docs"), F.col("n")), 6)
    score = F.round((F.col("relevance") + F.col("authority")) / 2, 6)
    return g.select("user_id", S.sufficient(score, F.col("n"), F.col("best"), 0.6).alias("sufficient"), S.improvement(score, F.col("n"), F.col("relevance"), (F.col("user_id") % 10) / 10, spread, F.col("authority")).alias("advice"))


register(
    "clm_sufficiency",
    _assessed,
    f"""WITH {_HITTED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, {_WEIGHT} AS w FROM h), g AS (SELECT user_id, count(*) AS n, max(relevance) FILTER (k <= 3) AS best, round(avg(relevance), 6) AS relevance, round(avg(w), 6) AS authority, count(DISTINCT document_id) AS docs FROM r GROUP BY user_id),
  s AS (SELECT *, round((relevance + authority) / 2, 6) AS score, round(CASE WHEN docs <= 1 THEN 0.2 ELSE least(1.5 * docs / n, 1.0) END, 6) AS spread FROM g), a AS (SELECT *, list_filter([CASE WHEN n < 3 THEN 'broaden' END, CASE WHEN relevance < 0.6 THEN 'rephrase' END, CASE WHEN user_id % 10 < 5 THEN 'decompose' END, CASE WHEN spread < 0.3 THEN 'more_sources' END, CASE WHEN authority < 0.5 THEN 'better_sources' END], lambda x: x IS NOT NULL) AS a FROM s)
  SELECT user_id, n >= 3 AND best >= 0.6 AND score >= 0.6 AS sufficient, CASE WHEN len(a) > 0 THEN array_to_string(a, '; ') WHEN score < 0.8 THEN 'ensemble' ELSE 'good' END AS advice FROM a""",
)


def _specific(spark, d):
    from quern.plans.phrases import asked

    return asked(spark, d).select("o_orderkey", F.round(S.specificity(F.col("q")), 6).alias("specificity"))


def _specific_sql() -> str:
    from quern.plans.phrases import ASKED, sql_any

    return f"""WITH {ASKED}, b AS (SELECT o_orderkey, q, least(len(regexp_extract_all(q, '\\S+')) / 15, 1.0) AS s FROM q), e AS (SELECT o_orderkey, q, CASE WHEN contains(lower(q), 'eip') THEN least(s + 0.2::DOUBLE, 1.0) ELSE s END AS s FROM b) SELECT o_orderkey, round(CASE WHEN {sql_any(S.SPECIFIC, 'lower(q)')} THEN least(s + 0.1::DOUBLE, 1.0) ELSE s END, 6)::DOUBLE AS specificity FROM e"""


register("clm_query_specificity", _specific, _specific_sql())
register("clm_source_type", lambda s, d: _hits(s, d).select("event_id", T.source_type(F.col("document_id")).alias("type")), f"WITH {_HITTED} SELECT event_id, CASE WHEN lower(document_id) LIKE 'eip-%' THEN 'eip' WHEN lower(document_id) LIKE '%magicians%' OR lower(document_id) LIKE '%forum%' THEN 'forum' WHEN lower(document_id) LIKE '%research%' THEN 'research' ELSE 'document' END AS type FROM h")

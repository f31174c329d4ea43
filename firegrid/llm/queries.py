"""Queries of this folder's operators over their whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.llm import chat, decontaminate, divergence, interpolation, jaccard, licenses, line_dedup, mixing, pseudonyms, quality, spelling, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- 1 chat formatting

_PROBE = "</s>[INST] ok [/INST]"


def _escaped(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for s in chat.CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


@query(
    "op1_chat_prefix_targets",
    f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'),
 p AS (SELECT *, length('{chat.OPEN}' || {_escaped("role")} || '{chat.SEP}' || {_escaped("text")} || '{chat.CLOSE}') AS n,
   row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
 e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS whole FROM p)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(whole) FILTER (role = 'assistant' OR i = m) AS BIGINT) AS formatted_chars,
 count(*) FILTER (role = 'assistant' OR i = m) AS n_examples
FROM e GROUP BY conv_id""",
)
def op1(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PROBE).alias("text"),
    )
    turns = turns.withColumn("turn", F.col("turn").cast("long"))
    return chat.digest(chat.prefix_examples(turns.unionByName(probe)))


# ---- 2 mixing sources to target weights

MIX_SEED = 17


@query(
    "op2_poisson_mixing",
    f"""WITH s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
 w AS (SELECT source, size, CASE WHEN size > 0 THEN 1.0e0 ELSE 0.0e0 END AS weight FROM s),
 r AS (SELECT source, weight / sum(weight) OVER () * sum(size) OVER () / size AS rate FROM w),
 q AS (SELECT source, rate, CAST(greatest(ceil(rate / {mixing.PART_MEAN}), 1) AS BIGINT) AS parts FROM r WHERE rate > 0),
 j AS (SELECT unnest(range(0, {mixing.TERMS})) AS j),
 p AS (SELECT source, parts, j, exp(-rate / parts + j * ln(rate / parts) - lgamma(j + 1)) AS p FROM q, j),
 c AS (SELECT source, parts, j, sum(p) OVER (PARTITION BY source ORDER BY j ROWS UNBOUNDED PRECEDING) AS c FROM p),
 a AS (SELECT source, parts, list(c ORDER BY j) AS cdf FROM c GROUP BY source, parts),
 d AS (SELECT documents.*, parts, cdf, unnest(range(1, parts + 1)) AS part FROM documents JOIN a ON documents.source IS NOT DISTINCT FROM a.source),
 u AS (SELECT * EXCLUDE (cdf), len(list_filter(cdf, lambda x: x <= CAST('0x' || substr(md5('{MIX_SEED}|' || doc_id || '|' || part), 1, 13) AS BIGINT) / {float(1 << 52)})) AS k FROM d),
 n AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS k FROM u GROUP BY doc_id),
 x AS (SELECT documents.*, unnest(range(0, k)) AS copy FROM documents JOIN n USING (doc_id))
SELECT *, CAST('0x' || substr(md5('{MIX_SEED}:place|' || doc_id || '|' || copy), 1, 13) AS BIGINT) AS shuffle_key FROM x""",
)
def op2(spark, d):
    return mixing.mix(table(spark, d, "documents"), seed=MIX_SEED)


# ---- 3 n-gram Jaccard join


@query("op3_jaccard_join")
def op3(spark, d):
    return jaccard.jaccard_join(table(spark, d, "documents"))


# ---- 4 quality rules

_SPACE = r"[\x20\x09-\x0D]"


def _rule_sql(r: quality.Rule) -> str:
    whole = "1" if r.denominator == "one" else r.denominator
    bad = []
    if r.lo is not None:
        bad.append(f"{r.numerator} * 1000 < {whole} * {round(r.lo * 1000)}")
    if r.hi is not None:
        bad.append(f"{r.numerator} * 1000 > {whole} * {round(r.hi * 1000)}")
    return f"(({' OR '.join(bad)}) AND {whole} > 0)"


@query(
    "op4_quality_rules",
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS words,
   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
 g AS (SELECT doc_id, i, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ') AS g FROM w, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS t(i)),
 h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
 v AS (SELECT doc_id, CAST(sum(s) AS BIGINT) AS n_repeat_words FROM (SELECT doc_id, least({quality.WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {quality.WINDOW})) AS s FROM h) GROUP BY doc_id),
 m AS (SELECT doc_id, len(words) AS n_words, len(lines) AS n_lines, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
   coalesce(n_repeat_words, 0) AS n_repeat_words,
   len(list_distinct(list_filter(list_transform(words, lambda x: lower(x)), lambda x: list_contains({list(quality.STOP_WORDS)}, x)))) AS n_stop_words,
   len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullet_lines,
   len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis_lines
   FROM w LEFT JOIN v USING (doc_id)),
 b AS (SELECT *, {" OR ".join(map(_rule_sql, quality.BASE))} AS base_failed, {" OR ".join(map(_rule_sql, quality.THRESHOLDS))} AS own_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR own_failed) AS kept FROM b""",
)
def op4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# ---- 5 URL filters

URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
LISTED = tuple((f"{name}.example.{top}", "listed") for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def _fits(pattern: str) -> str:
    host, _, path = pattern.partition("/")
    path = f"/{path}" if "/" in pattern else ""
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[0]))


@query(
    "op5_url_filter",
    f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
 r AS (SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(p)} THEN '{p}'" for p, _ in _BY_LENGTH)} END AS rule FROM h)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{p}' THEN '{a}'" for p, a in URL_RULES)}
 WHEN {" OR ".join(_fits(p) for p, _ in LISTED)} THEN 'block' ELSE 'allow' END AS verdict FROM r""",
)
def op5(spark, d):
    return urls.filter_urls(table(spark, d, "pages"), urls.UrlList(spark, URL_RULES + LISTED))


# ---- 6 toxicity


@query("op6_toxicity_compression")
def op6(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, table(spark, d, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.fold(F.col("doc_id")) == 0)


# ---- 7 licence scan


def _canonical_sql(col: str) -> str:
    t = f"regexp_replace(lower(coalesce({col}, '')), '{licenses.COPYRIGHT_LINE}', ' ', 'g')"
    t = f"replace(' ' || regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', ' ', '  ')"
    for a, b in licenses.EQUIVALENT:
        t = f"replace({t}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"trim(replace({t}, '  ', ' '), ' ')"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in licenses.KNOWN)


@query(
    "op7_license_scan",
    f"""WITH k AS (SELECT DISTINCT name AS license, {_canonical_sql("body")} AS body FROM (VALUES {_KNOWN_SQL}) AS t(name, body)),
 n AS (SELECT doc_id, 'document' AS scope, -1 AS line, text AS unit FROM documents
   UNION ALL SELECT doc_id, 'line', i - 1, string_split(text, chr(10))[i] FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)),
 c AS (SELECT doc_id, scope, line, {_canonical_sql("unit")} AS unit FROM n)
SELECT doc_id, scope, license, count(*) AS n_hits, CAST(min(line) AS BIGINT) AS first_line FROM c JOIN k ON sha256(c.unit) = sha256(k.body) GROUP BY doc_id, scope, license""",
)
def op7(spark, d):
    return licenses.scan(table(spark, d, "documents"))


# ---- 8 benchmark decontamination


@query("op8_simhash_decontamination")
def op8(spark, d):
    return decontaminate.find(table(spark, d, "documents"), table(spark, d, "benchmark"))


# ---- 9 personal data

# a key of the tests; production keys come from the job's secrets
PII_KEY = b"firegrid test key"


@query("op9_pii_pseudonyms")
def op9(spark, d):
    return pseudonyms.pseudonymize(table(spark, d, "documents"), PII_KEY)


# ---- 10 language-model scoring


@query("op10_deleted_interpolation")
def op10(spark, d):
    return interpolation.score(table(spark, d, "documents"))


# ---- 11 source divergence audit


@query(
    "op11_source_divergence",
    f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 o AS (SELECT i, lang, source, term, count(*) AS n FROM t GROUP BY i, lang, source, term),
 k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(*) >= {divergence.MIN_DOCS}),
 v AS (SELECT lang, count(*) AS V FROM k GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang)
   LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM o GROUP BY lang, source, term) AS s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
 a AS (SELECT lang, source, term, CAST(n AS HUGEINT) AS n, CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) AS N1, CAST(sum(n) OVER (PARTITION BY lang, term) AS HUGEINT) AS m, CAST(sum(n) OVER (PARTITION BY lang) AS HUGEINT) AS N2, CAST(v.V AS HUGEINT) AS V FROM c JOIN v USING (lang)),
 p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 5)) // (N1 + 5 * V) AS BIGINT) AS p, CAST(1 + (1000000000 * (m + 5)) // (N2 + 5 * V) AS BIGINT) AS q FROM a),
 x AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
 z AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z) QUALIFY part = 'pair' OR rank <= {divergence.TOP}""",
)
def op11(spark, d):
    return divergence.divergence(table(spark, d, "documents"))


# ---- 12 line deduplication


@query(
    "op12_line_runs",
    f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 u AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l, unnest(range(1, len(lines) + 1)) AS t(i)),
 k AS (SELECT key, max(doc_id) AS last FROM u WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
 j AS (SELECT doc_id, i, line, last IS NOT NULL AND last <> doc_id AS gone FROM u LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
)
def op12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# ---- 13 spelling variants

# crc32 of a string, byte by byte over the table of its polynomial
_CRC_TABLE = "list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


@query(
    "op13_spelling_variants",
    f"""WITH RECURSIVE c AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
 r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
 s AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM r WHERE length(run) >= {spelling.MIN_CHARS} GROUP BY ALL),
 h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM s, c),
 m AS (SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
 w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= {spelling.MIN_CHARS} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
 k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
 l AS (SELECT DISTINCT k.word, k.n, w.word AS short, w.n AS short_n FROM k JOIN w ON w.word = k.less),
 b AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM k AS a JOIN k AS b USING (i, less) WHERE a.word <> b.word
   UNION ALL SELECT word, n, short, short_n FROM l UNION ALL SELECT short, short_n, word, n FROM l),
 g AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM b GROUP BY word, n),
 f AS MATERIALIZED (SELECT word, near AS form, near_n AS form_n FROM g WHERE near_n >= {spelling.FACTOR} * n),
 o AS (SELECT word, form AS root FROM f UNION ALL SELECT o.word, f.form FROM o JOIN f ON f.word = o.root),
 z AS (SELECT word, root FROM o WHERE root NOT IN (SELECT word FROM f))
SELECT w.word, f.form, coalesce(z.root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n FROM w LEFT JOIN g USING (word) LEFT JOIN f USING (word) LEFT JOIN z USING (word)""",
)
def op13(spark, d):
    return spelling.variants(spelling.words_of(table(spark, d, "documents")))

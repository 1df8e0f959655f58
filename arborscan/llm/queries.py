"""Registered queries of the operators, each over its whole table, and their check statements.

``QUERIES`` maps names to ``(spark, folder) -> DataFrame``, ``ORACLES`` to DuckDB statements. Where
SQL cannot express an operator there is none, and the query is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborscan.llm import ann, chat, collocations, divergence, fragments, htmltext, langid, mixing, neardup, packing, tokenfile, tokens, topk, urlfilter
from arborscan.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle.strip()
        return fn

    return register


_UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@_query(f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS p, b.doc_id AS q FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT p, p AS q FROM links UNION SELECT r.p, l.q FROM reach r JOIN links l ON r.q = l.p),
c AS (SELECT p, min(q) AS c FROM reach GROUP BY p)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM s LEFT JOIN c ON p = doc_id""")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity of at least 0.85."""
    return neardup.groups(table(spark, sf_dir, "documents"), words=3, similarity=85)


@_query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of 2,048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.public())


_ESCAPED = "replace({}, '&', '&amp;')"
for _control, _mark in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_mark}')"


@_query(f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum({len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""")
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, folded, rendered and read back."""
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    formatted = chat.render(chat.fold(chat.rows_as_events(rows.unionByName(trap))))
    read = formatted.select("conv_id", "formatted", chat.turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@_query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every fiftieth embedding with all others."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


_MIX_SEED = "mix"


@_query(f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS available FROM d GROUP BY source),
l AS (SELECT max(ln(available::DOUBLE)) AS high, min(ln(available::DOUBLE)) AS low FROM t WHERE available > 0),
a AS (SELECT high, round(CASE WHEN high = low THEN 0 ELSE greatest(0, 1 - ln({mixing.MAX_REPEATS}) / (high - low)) END, 9) AS alpha FROM l),
m AS (SELECT any_value(high) AS high, any_value(alpha) AS alpha, sum(exp(alpha * (ln(available::DOUBLE) - high))) AS mass FROM t, a WHERE available > 0),
p AS (SELECT source, available, CASE WHEN available > 0 THEN exp(alpha * (ln(available::DOUBLE) - high)) / mass ELSE 0 END AS weight, high, mass FROM t, m),
b AS (SELECT source, available, weight, greatest(available, floor(weight * exp(high) * mass + 0.5))::BIGINT AS budget FROM p),
c AS (SELECT d.doc_id, d.source, d.n_tokens, b.* EXCLUDE (source), e.epoch FROM d JOIN b USING (source)
 JOIN (SELECT unnest(range(100))::INTEGER AS epoch) e ON e.epoch < greatest(1, ceil(budget / greatest(available, 1)))),
o AS (SELECT *, md5('{_MIX_SEED}|' || epoch || '|' || doc_id) AS place FROM c WHERE n_tokens > 0 OR epoch = 0),
r AS (SELECT *, epoch * available + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place, doc_id, n_tokens
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o)
SELECT doc_id, source, n_tokens, epoch, floor(start / greatest(1, weight * {mixing.BLOCK_TOKENS}))::BIGINT AS block, place FROM r
WHERE start < budget OR n_tokens = 0""")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by temperature: every document at least once, no source repeated more than twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("n_tokens"))
    mixed = mixing.mix(docs, "n_tokens", _MIX_SEED)
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_tokens", "epoch", "block", "place")


@_query()
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, by wrappers of their hosts."""
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.learn(pages)).select("page_id", "url", "text", "n_chars")


@_query()
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings found for every twentieth one."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@_query()
def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token-id files and read back."""
    folder = tokenfile.write(table(spark, sf_dir, "documents"), tokens.public())
    return tokenfile.read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@_query()
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; documents of the held-out fold teach nothing."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _rules(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")

def _level(name: str, source: str) -> str:
    return f"""{name} AS (SELECT coalesce(mean, 0) AS mean, coalesce(CASE WHEN between_ <= 0 THEN {urlfilter.STRONGEST}
 ELSE greatest(1, least({urlfilter.STRONGEST}, drawn / between_ - 1)) END, {urlfilter.STRONGEST}) AS strength FROM (SELECT *, (sq / n - mean * mean) - drawn * k / n AS between_
 FROM (SELECT *, mean * (1 - mean) AS drawn FROM (SELECT *, bad / n AS mean FROM (SELECT nullif(sum(n), 0)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*)::DOUBLE AS k,
 sum((bad * bad)::DOUBLE / n) AS sq FROM {source})))))"""


@_query(f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
g AS (SELECT *, CASE WHEN instr(host, '.') = 0 THEN host ELSE regexp_extract(host, '([^.]*\\.[^.]*)$', 1) END AS domain, regexp_extract(host, '([^.]*)$', 1) AS suffix FROM s),
rules(top, prefix, verdict) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
fit AS (SELECT page_id, top || prefix AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(top || prefix) DESC, length(top) DESC, verdict) AS rn
 FROM s JOIN rules ON (host = top OR ends_with(host, '.' || top)) AND starts_with(path, prefix)),
o AS (SELECT g.*, (quality = 0 OR toxic = 1)::BIGINT AS bad FROM g JOIN labels ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT)),
h AS (SELECT host, domain, suffix, count(*) AS n, sum(bad)::BIGINT AS bad FROM o GROUP BY ALL), d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM d GROUP BY ALL),
{_level('l1', 'x')}, {_level('l2', 'd')}, {_level('l3', 'h')},
p1 AS (SELECT DISTINCT g.host, g.domain, (coalesce(x.bad, 0) + l1.strength * l1.mean) / (coalesce(x.n, 0) + l1.strength) AS p FROM g LEFT JOIN x USING (suffix), l1),
p2 AS (SELECT host, (coalesce(d.bad, 0) + l2.strength * p) / (coalesce(d.n, 0) + l2.strength) AS p FROM p1 LEFT JOIN d USING (domain), l2),
ab AS (SELECT p2.host, l3.strength * p + coalesce(h.bad, 0) AS a, l3.strength * (1 - p) + coalesce(h.n - h.bad, 0) AS b FROM p2 LEFT JOIN h USING (host), l3),
v AS (SELECT host, a / (a + b) AS mean, a + b + 1 AS mass FROM ab)
SELECT s.page_id, s.host, s.path, rule, coalesce(fit.verdict, CASE WHEN mean - {urlfilter.Z} * sqrt(mean * (1 - mean) / mass) > {urlfilter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM s JOIN v USING (host) LEFT JOIN fit ON fit.page_id = s.page_id AND rn = 1""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page urls judged by rules, else by host reputation; outcomes are the labels of the documents the urls name."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    named = F.regexp_extract(urlfilter.path(F.col("url")), "/([0-9]+)", 1).try_cast("long")
    outcomes = pages.select("url", named.alias("doc_id")).join(
        labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")), "doc_id").select("url", "bad")
    return urlfilter.judge(pages, _rules(spark, URL_RULES), outcomes)


@_query(f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), {_UPPER_LOWER}), '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
u AS (SELECT lang, unnest(w) AS phrase FROM w),
g AS (SELECT lang, phrase, 1 AS m FROM u
 UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w
 UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM w),
f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {collocations.MIN_COUNT}),
n AS (SELECT lang, count(*) AS n FROM u GROUP BY lang),
s AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
c AS (SELECT lang, phrase, f AS a, w, unnest(range(1, m)) AS k FROM s),
x AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM c
 JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM s WHERE m = 3),
gone AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase AND 100 * longer.f >= {collocations.SHARE} * b.a),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
 FROM b JOIN n USING (lang) ANTI JOIN gone USING (lang, phrase))
SELECT * FROM o WHERE rank <= {collocations.TOP}""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of two and three words that stand together most in every language, over all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))


@_query(f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS p, b.doc_id AS q FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT p, p AS q FROM links UNION SELECT r.p, l.q FROM reach r JOIN links l ON r.q = l.p),
c AS (SELECT p, min(q) AS c FROM reach GROUP BY p)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM s LEFT JOIN c ON p = doc_id""")
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose three-word shingles are similar by at least 0.9."""
    return fragments.groups(table(spark, sf_dir, "documents"))


@_query(f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), {_UPPER_LOWER}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= {divergence.MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
 LEFT JOIN (SELECT lang, source, n FROM c JOIN k USING (lang, term)) USING (lang, source) GROUP BY ALL),
a AS (SELECT lang, sum(n) AS n FROM g GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, 1 + ({divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v)::HUGEINT AS p
 FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + ({divergence.SCALE}::HUGEINT * (sum(c.n) + 2)::HUGEINT) // (any_value(a.n) + 2 * any_value(v.v))::HUGEINT AS q
 FROM c JOIN k USING (lang, term) JOIN a USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
 FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
all_pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
 LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE count > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM all_pairs
 UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {divergence.TOP}""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of every language differ in their words, over all documents."""
    return divergence.audit(table(spark, sf_dir, "documents"))

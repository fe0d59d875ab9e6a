"""The operators of this package applied to the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import (
    byte_bpe,
    decontaminate,
    embedding_dedup,
    html_extract,
    language_id,
    lexical_search,
    licenses,
    minhash_dedup,
    mixing,
    substring_dedup,
    token_count,
    url_filter,
    vector_codes,
)
from metricloom.session import materialize, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col
TOKEN_LIMIT = 4096
# Fixed values: (host, path, verdict) of the rules that op3 applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def _(spark, d):
    """Language of every document; the model is fitted on rows that are not held out."""
    docs = table(spark, d, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(c("doc_id"))))
    out = language_id.identify(docs, model)
    return out.select("doc_id", language_id.held_out(c("doc_id")).alias("held_out"), "lang_pred", "score", "lang_share")


REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, unnest(generate_series(1, len(ws) - 34)) AS p, ws FROM d WHERE len(ws) >= 35),
keyed AS (SELECT r, p, array_to_string(ws[p:p + 34], ' ') AS k FROM win),
dup AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(p, p + 34)) AS p FROM keyed WHERE k IN (SELECT k FROM dup)),
word AS (SELECT r, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS w FROM d),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


@query("op2_substring_dedup", REPEATS_SQL)
def _(spark, d):
    """Words of every document that no repeated window of 35 words covers."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


URL_SQL = r"""
WITH RECURSIVE rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
links AS (
  SELECT url, CASE WHEN l LIKE '%://%' THEN l
      WHEN l LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || l
      WHEN l LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || l
      ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') || l END AS target
  FROM (
    SELECT url, replace(l, '&amp;', '&') AS l FROM (
      SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS l FROM pages
      UNION ALL
      SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) AS l FROM pages)
    WHERE l <> '' AND url IS NOT NULL)),
urls AS (SELECT url FROM pages UNION SELECT target FROM links),
parts AS (
  SELECT url, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|msclkid)(=.*)?$')) AS q
  FROM urls),
named AS (
  SELECT url, host, path, CASE WHEN url LIKE '%://%' THEN regexp_replace(host, '^(www|m|mobile|amp)\.', '')
      || regexp_replace(path, '(?i)(/index)?(\.html?)?/*$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END
    ELSE '?' || coalesce(url, '') END AS node
  FROM parts),
fit AS (
  SELECT host, path, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(v, len(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY host, path),
edge AS (
  SELECT a.node AS u, b.node AS v FROM links JOIN named a ON a.url = links.url JOIN named b ON b.url = links.target
  UNION SELECT b.node, a.node FROM links JOIN named a ON a.url = links.url JOIN named b ON b.url = links.target),
reach AS (SELECT DISTINCT node, node AS r FROM named UNION SELECT edge.v, reach.r FROM reach JOIN edge ON reach.node = edge.u),
comp AS (SELECT node, min(r) AS c FROM reach GROUP BY node),
blocked AS (
  SELECT c FROM named JOIN comp USING (node) JOIN fit USING (host, path) GROUP BY c
  HAVING bool_or(v = 'block') AND NOT bool_or(v = 'allow'))
SELECT page_id, named.host, named.path, rule, coalesce(v, CASE WHEN c IN (SELECT c FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN named ON named.url IS NOT DISTINCT FROM pages.url JOIN comp USING (node)
LEFT JOIN fit ON fit.host = named.host AND fit.path = named.path"""


@query("op3_url_filter", URL_SQL)
def _(spark, d):
    """Verdict of every page's address by rules and by its aliases."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = url_filter.filter_urls(table(spark, d, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query("op4_token_counts")
def _(spark, d):
    """Token counts of every document."""
    out = token_count.count_tokens(table(spark, d, "documents").select("doc_id", "text"), TOKEN_LIMIT)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op5_decontamination")
def _(spark, d):
    """Benchmark items found in documents."""
    return decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r, r AS s FROM v UNION SELECT link.b, reach.s FROM reach JOIN link ON reach.r = link.a),
comp AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.s GROUP BY reach.r)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = v.r) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp USING (r)"""


@query("op6_embedding_dedup", EMBEDDING_SQL)
def _(spark, d):
    """Groups of vectors with one label and a cosine of at least 0.93."""
    return embedding_dedup.similar_vectors(table(spark, d, "embeddings"), threshold=0.93)


@query("op7_licences")
def _(spark, d):
    """Licences that every document states."""
    out = licenses.scan_licences(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "licences", "licence_sentences")


@query("op8_main_text")
def _(spark, d):
    """Main text of every page."""
    out = html_extract.extract_text(table(spark, d, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


ROUNDS = 12
MIX_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
l0 AS (SELECT 0.0::DOUBLE AS rate)"""
    + "".join(
        f""",
l{i + 1} AS (SELECT coalesce((sum(s) - 3 * coalesce(sum(s) FILTER (3 * s < w * rate), 0)) / CAST(sum(w) FILTER (NOT 3 * s < w * rate) AS DOUBLE), any_value(rate)) AS rate FROM per, l{i})"""
        for i in range(ROUNDS)
    )
    + f""",
goal AS (SELECT source, s, CASE WHEN 3 * s < w * rate THEN 3.0 * s ELSE w * rate END AS target FROM per, l{ROUNDS}),
plan AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS q FROM goal),
run AS (
  SELECT d.source, h, sum(size) AS g, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) - sum(size) AS before
  FROM d WHERE size > 0 GROUP BY d.source, h),
edge AS (
  SELECT run.source, h AS edge, 2 * (target - q * s - before) >= g AS with_edge
  FROM run JOIN plan ON run.source IS NOT DISTINCT FROM plan.source
  WHERE before <= target - q * s AND target - q * s < before + g)
SELECT doc_id, size, s AS source_size, target,
  CAST(size * (q + CASE WHEN h < edge OR h = edge AND with_edge THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source LEFT JOIN edge ON d.source IS NOT DISTINCT FROM edge.source"""
)


@query("op9_source_mix", MIX_SQL)
def _(spark, d):
    """Words that the mix takes of every document."""
    docs = table(spark, d, "documents")
    sized = materialize(docs.select("doc_id", "source", mixing.word_count(c("text")).alias("size")), "mix-rows")
    return mixing.mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_minhash_dedup")
def _(spark, d):
    """Groups of documents whose sets of two-word shingles overlap by 80 percent."""
    return minhash_dedup.near_duplicates(table(spark, d, "documents"), length=2, percent=80)


@query("op11_byte_bpe")
def _(spark, d):
    """Token ids of every document and the bytes they stand for, as digests."""
    out = byte_bpe.encode(table(spark, d, "documents").select("doc_id", "text"), keep_text=False)
    counted = out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "ids")
    return byte_bpe.decode(counted).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


SEARCH_SQL = r"""
WITH src AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM src),
tf AS (SELECT r, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
tot AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM len),
m AS (SELECT r, 10 + (90 * len.n * tot.n) // tot.l AS m FROM len, tot),
item AS (SELECT row_number() OVER () AS q, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
want AS (SELECT DISTINCT q, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM item),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * tot.n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, tot),
score AS (
  SELECT q, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM want JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY q, r HAVING sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM score JOIN src USING (r) JOIN item USING (q)) WHERE rank <= 10"""


@query("op12_lexical_search", SEARCH_SQL)
def _(spark, d):
    """The ten best documents for every benchmark item."""
    return lexical_search.search(table(spark, d, "documents"), table(spark, d, "benchmark"), k=10)


CODES_ROUNDS = 4


def _codes_sql(rounds: int) -> str:
    """Lloyd's rounds in full: every part against every entry."""
    part = "list_transform(embedding[len(embedding) // 4 * {0} + 1:len(embedding) // 4 * ({0} + 1)], lambda x: floor(1024 * CAST(x AS DOUBLE)))"
    sql = f"""
WITH ok AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
num AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r FROM ok),
part AS MATERIALIZED ({" UNION ALL ".join(f"SELECT r, {p} AS p, {part.format(p)} AS q FROM num" for p in range(4))}),
book0 AS MATERIALIZED (SELECT p, r AS e, q AS c FROM part WHERE r < 256)"""
    nearest = """SELECT r, p, min(CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 256 + e) AS near FROM part JOIN {0} USING (p) GROUP BY r, p"""
    for k in range(rounds):
        sql += f""",
near{k} AS MATERIALIZED ({nearest.format(f"book{k}")}),
sum{k} AS (SELECT p, near % 256 AS e, i, CAST(sum(q[i]) AS HUGEINT) AS s, count(*) AS n FROM part JOIN near{k} USING (r, p), unnest(range(1, len(q) + 1)) AS t(i) GROUP BY ALL),
mean{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM sum{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))"""
    return sql + f""",
last AS MATERIALIZED ({nearest.format(f"book{rounds}")}),
code AS (SELECT r, lower(string_agg(printf('%02x', near % 256), '' ORDER BY p)) AS code, CAST(sum(near // 256) AS BIGINT) AS error FROM last GROUP BY r),
named AS (SELECT vec_id, label, code, error FROM code JOIN num USING (r)),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM named, digest"""


@query("op13_vector_codes", _codes_sql(CODES_ROUNDS))
def _(spark, d):
    """Code and error of every vector, and the digest of the codebooks."""
    rows, books = vector_codes.compress(table(spark, d, "embeddings"), columns=["label"], parts=4, entries=256, rounds=CODES_ROUNDS)
    error = F.aggregate("distances", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    out = rows.select("vec_id", "label", vector_codes.code_text().alias("code"), error.alias("error"))
    out = vector_codes.with_group_sum(out, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


@query("pipeline")
def _(spark, d):
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)

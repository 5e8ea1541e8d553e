"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimwire.llm import decontaminate, fingerprint, html, jaccard, langid, lm, mixing, secrets, toxicity, urls
from slimwire.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


WORDS_SQL = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

# Words and sources; targets by how soon a source is full; whole passes, then documents along the seeded order, each one that
# still fits what is left of its source's target.
MIX_SQL = """WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, CAST(coalesce(len(""" + WORDS_SQL.format(text="text") + """), 0) AS BIGINT) AS size,
             md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), concat('text:', md5(coalesce(text, '')))))) AS h FROM documents),
 s AS (SELECT source, sum(size) AS words, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
 w AS (SELECT *, CASE r % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight, 1.5 * sum(words) OVER () AS total FROM s),
 o AS (SELECT *, coalesce(sum(2 * words) OVER q, 0) AS before, sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS open_weight FROM w
       WINDOW q AS (ORDER BY 2.0 * words / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, CAST(total - before AS DOUBLE) * weight / CAST(open_weight AS DOUBLE) >= 2 * words AS is_full FROM o),
 l AS (SELECT total - coalesce(sum(2 * words) FILTER (WHERE is_full), 0) AS rest, sum(weight) FILTER (WHERE NOT is_full) AS open_weight FROM f GROUP BY total),
 t AS (SELECT source, words, CASE WHEN is_full THEN CAST(2 * words AS DOUBLE) ELSE CAST(l.rest AS DOUBLE) * weight / CAST(l.open_weight AS DOUBLE) END AS target FROM f, l),
 k AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), CAST(2 * words AS BIGINT)) AS wanted FROM t),
 p AS (SELECT *, CASE WHEN words > 0 THEN wanted // words ELSE 0 END AS passes, CASE WHEN words > 0 THEN wanted % words ELSE 0 END AS rest FROM k),
 u AS (SELECT source, list(n ORDER BY h, doc_id NULLS FIRST, size, n) AS ns, list(size ORDER BY h, doc_id NULLS FIRST, size, n) AS sizes FROM d WHERE size > 0 GROUP BY source),
 g AS (SELECT u.source, ns, list_reduce(list_prepend({'spare': CAST(rest AS BIGINT), 'more': CAST([] AS INTEGER[])}, list_transform(sizes, lambda x: {'spare': x, 'more': CAST([] AS INTEGER[])})),
         lambda a, x: CASE WHEN x.spare <= a.spare THEN {'spare': a.spare - x.spare, 'more': list_append(a.more, 1)} ELSE {'spare': a.spare, 'more': list_append(a.more, 0)} END).more AS more
       FROM u JOIN p ON p.source IS NOT DISTINCT FROM u.source),
 m AS (SELECT unnest(ns) AS n, unnest(more) AS more FROM g)
SELECT d.doc_id, d.size, CAST(p.words AS BIGINT) AS source_size, p.target, CAST(d.size * (p.passes + CASE WHEN p.passes < 2 THEN coalesce(m.more, 0) ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source LEFT JOIN m ON m.n = d.n"""

# All pairs that share a shingle, and what links reach.
JACCARD_SQL = """WITH RECURSIVE w AS (SELECT doc_id, """ + WORDS_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """ AS w FROM documents),
 i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM i),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
 g AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
 reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.y, reach.r FROM reach JOIN g ON g.x = reach.d)
SELECT d AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.d GROUP BY d"""

ORACLE.update({"op5_mix_sources": MIX_SQL, "op6_jaccard_join": JACCARD_SQL})


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(table(spark, sf_dir, "documents"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


@query
def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


@query
def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


from slimwire.llm import queries_corpus  # noqa: E402, F401  registers operators 11 to 13

"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, html_text, lang_id, license_scan, mixing, near_dup, pii, quality, set_join, spelling, token_file, url_filter
from .tokenizers import word_tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HELD_OUT = "coalesce(crc32(cast(doc_id AS string)) % 5 = 0, false)"


def language_model(documents: DataFrame) -> lang_id.Model:
    return lang_id.train(documents.where(f"NOT {HELD_OUT}").select("doc_id", "text", "lang"))


@query("op1_language_id")
def language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = lang_id.identify(documents, language_model(documents))
    return found.withColumn("held_out", F.expr(HELD_OUT)).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte", "accepted")


@query("op7_token_ids")
def tokens(spark, sf_dir):
    segments = token_file.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer())
    return token_file.read_documents(segments)


@query("op8_near_duplicates")
def duplicates(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
num AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS number FROM src),
wt AS (SELECT *, CAST([5, 2, 1][(number - 1) % 3 + 1] AS DOUBLE) AS weight, 2 * CAST(source_size AS DOUBLE) AS cap FROM num),
lv AS (SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
       FROM wt WINDOW before AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT source, number, source_size, least(cap, coalesce((min({'r': ratio, 'n': number, 'l': level}) FILTER (WHERE level <= ratio) OVER ()).l, 'infinity'::DOUBLE) * weight) AS target FROM lv),
bd AS (SELECT *, CAST(ceil(round(target) / 1024) AS BIGINT) AS blocks, sum(target) OVER (ORDER BY number) AS upto, sum(target) OVER () AS total FROM tg),
pt AS (SELECT i AS slot, (i % 2147483648 * 1327217885 % 2147483648) / 2147483648.0::DOUBLE AS point FROM range((SELECT CAST(coalesce(sum(blocks), 0) AS BIGINT) FROM bd)) AS r(i)),
pl AS (SELECT number, blocks, slot, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS rank
       FROM pt JOIN bd ON target > 0 AND point >= (upto - target) / total AND point < upto / total),
sl AS (SELECT number, rank, slot FROM pl WHERE rank < blocks
       UNION ALL
       SELECT number, rank, (SELECT count(*) FROM pt) + rank
       FROM (SELECT bd.number, unnest(range((SELECT count(*) FROM pl WHERE pl.number = bd.number AND rank < pl.blocks), bd.blocks)) AS rank FROM bd)),
laid AS (SELECT s.doc_id, s.size, t.number, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS quota,
           CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS BIGINT) AS pos
         FROM sized s JOIN tg t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(least(size, greatest(0, quota - pos)) + least(size, greatest(0, quota - source_size - pos)) AS BIGINT) AS taken,
  a.slot AS slot, b.slot AS slot_again
FROM laid
LEFT JOIN sl a ON a.number = laid.number AND a.rank = pos // 1024 AND size > 0 AND pos < quota
LEFT JOIN sl b ON b.number = laid.number AND b.rank = (pos + source_size) // 1024 AND size > 0 AND pos + source_size < quota
"""


@query("op9_mix", MIX_SQL)
def mixed(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_decontaminate")
def decontaminated(spark, sf_dir):
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op2_quality_rules")
def quality_rules(spark, sf_dir):
    kept = quality.judge(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _url_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of the table: a third is listed, taken off later, and a part listed again."""
    hosts = pages.select(url_filter.host_of("url").alias("host")).where("host <> ''").distinct()
    draw = lambda a: F.conv(F.substring(F.md5(F.col("host").cast("binary")), a, 4), 16, 10).cast("int")
    hosts = hosts.select(F.col("host").alias("pattern"), draw(1).alias("a"), draw(5).alias("b"), draw(9).alias("c")).where("a % 3 = 0 OR pattern LIKE '%adult%'")
    category = F.when(F.col("pattern").contains("adult"), "adult").when(F.col("a") % 2 == 0, "spam").otherwise("malware")
    first = (F.col("b") % 365).alias("day")
    gone = (F.col("b") % 365 + 1 + F.col("c") % 200).alias("day")
    back = (F.col("b") % 365 + 201 + F.col("c") % 200).alias("day")
    part = lambda day, action, which="true": hosts.where(which).select("pattern", category.alias("category"), day, F.lit(action).alias("action"))
    return part(first, "add").union(part(gone, "remove")).union(part(back, "add", "c % 4 = 0"))


URL_SQL = r"""
WITH named AS (SELECT page_id, url, CAST((page_id * 37) % 730 AS INT) AS day, lower(regexp_replace(regexp_replace(regexp_replace(
            regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host FROM pages),
hosts AS (SELECT DISTINCT host FROM named WHERE host <> ''),
drawn AS (SELECT host AS pattern, CAST('0x' || substr(md5(host), 1, 4) AS INT) AS a, CAST('0x' || substr(md5(host), 5, 4) AS INT) AS b, CAST('0x' || substr(md5(host), 9, 4) AS INT) AS c FROM hosts),
listed AS (SELECT *, CASE WHEN contains(pattern, 'adult') THEN 'adult' WHEN a % 2 = 0 THEN 'spam' ELSE 'malware' END AS category FROM drawn WHERE a % 3 = 0 OR contains(pattern, 'adult')),
spans AS (SELECT pattern, category, b % 365 AS lo, b % 365 + 1 + c % 200 AS hi FROM listed
          UNION ALL SELECT pattern, category, b % 365 + 201 + c % 200, NULL FROM listed WHERE c % 4 = 0),
suffixes AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') AS pattern FROM hosts, unnest(range(1, 100)) AS u(i) WHERE i <= len(string_split(host, '.'))),
hit AS (SELECT n.page_id, n.url, s.category FROM named n JOIN suffixes x ON n.host = x.host JOIN spans s ON x.pattern = s.pattern AND s.lo <= n.day AND (s.hi IS NULL OR n.day < s.hi)),
per AS (SELECT page_id, url, count(*) AS n_active, min(category) AS category FROM hit GROUP BY page_id, url)
SELECT n.page_id, n.url, n.host, n.day, coalesce(p.n_active, 0) AS n_active, p.category, p.n_active IS NOT NULL AS blocked
FROM named n LEFT JOIN per p ON n.page_id = p.page_id AND n.url = p.url
"""


@query("op5_url_filter", URL_SQL)
def url_filters(spark, sf_dir):
    """The pages table has no fetch time; the day is made from the page id, the list from the hosts."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("CAST((page_id * 37) % 730 AS INT)").alias("day"))
    return url_filter.apply_list(captures, _url_list(pages)).select("page_id", "url", "host", "day", "n_active", "category", "blocked")


@query("op6_license_scan")
def licenses(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.templates(spark))


@query("op3_main_text")
def main_texts(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op4_personal_data")
def personal_data(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op12_fill_in_middle")
def fill_in_middle(spark, sf_dir):
    made = fim.transform(table(spark, sf_dir, "documents")).withColumn("restored", fim.restored())
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


@query("op13_spelling_variants")
def spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


@query("op11_ngram_join")
def ngram_join(spark, sf_dir):
    return set_join.similar_sets(table(spark, sf_dir, "documents"))

"""The corpus operators as queries over the test tables, and SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.llm import decontaminate, exact_dedup, packing, sharding, simhash, substring_dedup, token_counts, tokens, toxicity, url_filter, warc
from chunkwise.llm._common import LOWER, UPPER, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 that differ by one row at most, in random order."""
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 3-word SimHash and the least document it reaches over links of 2 bits or fewer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicates(docs, k=3, distance=2)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the contract's rules, else by words in its host's labels."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.judge(pages, "url", [*url_filter.CONTRACT, *url_filter.SPAM])
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a lexicon learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(~toxicity.training_part(F.col("id")) & F.col("id").isNotNull(), F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that a document shares with another, nearly or exactly."""
    docs = table(spark, sf_dir, "documents")
    return substring_dedup.passages(docs, k=5, words=50, similarity=0.8).withColumnsRenamed({"id": "doc_id", "partner": "partner_id"})


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds 0.8 or more of a benchmark item's 5-word shingles, with the item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = decontaminate.find(docs, items, k=5, threshold=0.8)
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "containment", "shared", "shingles")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document of equal text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.content_sort(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, and where it is packed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, tokens.public_byte_bpe(), capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and tokens left when cut there: for every encoded length of a document, every limit and quantile."""
    return token_counts.report(token_counts.histogram(table(spark, sf_dir, "documents"), tokens.public_byte_bpe()))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a ZIP-packaged web archive and read back by ranges."""
    out = warc.archived(table(spark, sf_dir, "pages"), least_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
}

_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"



def _words(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


ORACLE_SQL = {
    "op3_url_filter": f"""
        WITH rest AS (SELECT page_id, coalesce({_REST}, '') AS rest FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
            END AS rule FROM parts
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN len(list_filter(string_split(host, '.')[:-2], lambda l:
                len(list_intersect({_words(url_filter.STRONG)}, regexp_extract_all(l, '[a-z0-9]+'))) >= 1
                OR len(list_intersect({_words(url_filter.WEAK)}, regexp_extract_all(l, '[a-z0-9]+'))) >= 2)) > 0 THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op6_decontaminate": """
        WITH words AS (
            SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
            UNION ALL
            SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
        ),
        cut AS (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
        shingled AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') || '|' || least(len(w), 5) AS s FROM cut),
        sizes AS (SELECT id, count(*) AS n FROM shingled WHERE kind = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, count(*) / any_value(n)::DOUBLE AS containment, count(*) AS shared, any_value(n) AS shingles
        FROM shingled d JOIN shingled i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN sizes z ON z.id = i.id
        GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n)
    """,
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (
            SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS smallest
            FROM p
        )
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
                   ((16 * (instr('0123456789abcdef', substr(h, 1 + 5 * i // 4, 1)) - 1) + instr('0123456789abcdef', substr(h, 2 + 5 * i // 4, 1)) - 1)
                   >> (3 - (5 * i % 4))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = smallest THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> smallest THEN smallest END AS refers_to
        FROM d
    """,
}

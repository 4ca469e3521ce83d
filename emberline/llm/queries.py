"""The queries over this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.llm.common import table
from emberline.llm.mixing import mix
from emberline.llm.urls import Rule, judge_urls

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources at shares in proportion to the square root of their documents, by blocks of 8."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"), power=0.5, block_rows=8)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With component_id: the smallest doc_id reachable by fingerprints that are alike by 0.8 or more."""
    from emberline.llm.fingerprints import compare_edited, near_by_edits

    return near_by_edits(compare_edited(table(spark, sf_dir, "documents"))).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.language import classify_languages

    return classify_languages(table(spark, sf_dir, "documents"))


#: Fixed values of the task.
RULES = [Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/")]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.suffixes import digests

    return digests(table(spark, sf_dir, "documents"), 100)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each leak of a benchmark item in a document."""
    from pyspark.sql import functions as F

    from emberline.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("contaminated", F.lit(True))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the benchmark's words."""
    from emberline.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, buckets=10_000, longest=2, seed=7)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.llm.infill import digests

    return digests(table(spark, sf_dir, "documents"), unit="character", seed=1, keep_percent=90, spm_percent=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_fingerprints": op2_fingerprints,
    "op3_language": op3_language,
    "op4_urls": op4_urls,
    "op5_warc": op5_warc,
    "op6_suffixes": op6_suffixes,
    "op7_quality": op7_quality,
    "op8_minhash": op8_minhash,
    "op9_token_files": op9_token_files,
    "op10_decontamination": op10_decontamination,
    "op11_bpe": op11_bpe,
    "op12_resampling": op12_resampling,
    "op13_infill": op13_infill,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PAIRS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
#: crc32, bit by bit: each byte is followed by eight steps.
_STEPS = "flatten(list_transform(range(1, len(h), 2), lambda i: list_concat([CAST('0x' || h[i:i + 1] AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
_CRC = f"xor(4294967295, list_reduce({_STEPS}, lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, 3988292384 * (s & 1)) END, 4294967295))"

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
             s AS (SELECT *, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
             g AS (SELECT payload_digest, max(page_id) AS lead FROM s WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN lead IS NOT NULL AND page_id IS DISTINCT FROM lead THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM lead THEN lead END AS refers_to,
               regexp_replace(regexp_replace(url, chr(13), '%0D', 'g'), chr(10), '%0A', 'g') AS url
        FROM s LEFT JOIN g USING (payload_digest)
    """,
    "op8_minhash": """
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM d),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
             l AS (SELECT i, j FROM c JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * k >= 80 * (a.n + b.n - k)),
             v AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
             t AS (SELECT i, j FROM v UNION SELECT t.i, v.j FROM t JOIN v ON t.j = v.i)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(t.j)) AS component_id, d.doc_id <= coalesce(min(t.j), d.doc_id) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t ON t.i = d.doc_id GROUP BY d.doc_id, n.n
    """,
    "op12_resampling": f"""
        WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
             f AS (SELECT i, doc_id, unnest(list_concat(w, {_PAIRS})) AS f FROM d), g AS (SELECT unnest(list_concat(w, {_PAIRS})) AS f FROM b),
             x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM f UNION SELECT f FROM g)), k AS (SELECT f, {_CRC} % 10000 AS k FROM x),
             own AS (SELECT k, count(*) AS s FROM f JOIN k USING (f) GROUP BY k), aim AS (SELECT k, count(*) AS t FROM g JOIN k USING (f) GROUP BY k),
             n AS (SELECT (SELECT count(*) FROM f) AS s_all, (SELECT count(*) FROM g) AS t_all),
             gain AS (SELECT k, floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS gain FROM own LEFT JOIN aim USING (k), n),
             m AS (SELECT i, count(*) AS n, CAST(sum(CAST(gain AS BIGINT)) AS BIGINT) AS sum FROM f JOIN k USING (f) JOIN gain USING (k) GROUP BY i),
             h AS (SELECT d.*, coalesce(n, 0) AS n_features, coalesce(CAST(floor(sum / n) AS BIGINT), 0) AS weight, CAST(CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS DOUBLE) AS h FROM d LEFT JOIN m USING (i)),
             q AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
             r AS (SELECT i, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank FROM q WHERE len(w) >= 20)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM q LEFT JOIN r USING (i)
    """,
    "op13_infill": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
             d AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
             c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
             p AS (SELECT *, left(t, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p
    """,
}

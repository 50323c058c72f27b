"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, fingerprints, jaccard, licences, packing, rules, suffixes, unigram, urls, warc
from .common import prepare, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-neighbour votes for every whole text of documents."""
    prepare(spark)
    return classify.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host-level quality rules over every whole text of documents."""
    prepare(spark)
    return rules.host_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "host_rate", "kept"
    )


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of every whole text and its edited form."""
    prepare(spark)
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets agree by 85 %."""
    prepare(spark)
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM c LEFT JOIN n ON c.doc_id = n.doc_id LEFT JOIN k ON c.doc_id = k.doc_id
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every whole text of documents."""
    prepare(spark)
    return licences.summary(licences.scan(table(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and language models judge every url of pages."""
    prepare(spark)
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings removed from every whole text of documents."""
    prepare(spark)
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: The copy that is audited: of every 61st page the first character is
#: overwritten, and every 89th is longer or shorter.
OP8_REPLICA = """CASE WHEN page_id % 61 = 0 THEN concat('?', substring(payload, 2))
  WHEN page_id % 178 = 0 THEN concat(payload, '+') WHEN page_id % 89 = 0 THEN substring(payload, 12) ELSE payload END"""


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive of all pages against a copy with damaged records."""
    prepare(spark)
    return warc.audit_pages(table(spark, sf_dir, "pages"), F.expr(OP8_REPLICA))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS ours,
    coalesce(CASE WHEN page_id % 61 = 0 THEN '?' || substring(html, 2)
      WHEN page_id % 178 = 0 THEN html || '+' WHEN page_id % 89 = 0 THEN substring(html, 12) ELSE html END, '') AS theirs
  FROM pages
),
r AS (
  SELECT page_id,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
      || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(ours)
      || chr(13) || chr(10) || chr(13) || chr(10) || ours || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    ours = theirs AS same
  FROM p
),
m AS (
  SELECT page_id, strlen(record)::BIGINT AS length, sha256(record) AS digest, same, count(*)::BIGINT AS copies
  FROM r GROUP BY ALL
)
SELECT page_id, floor(page_id / 1000)::BIGINT AS file,
  coalesce(sum(length * copies) OVER (PARTITION BY floor(page_id / 1000) ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset,
  length, copies, digest, CASE WHEN same THEN 'ok' ELSE 'damaged' END AS status
FROM m
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of 4096."""
    prepare(spark)
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op10_unigram_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram ids of every whole text, and the text decoded from them."""
    prepare(spark)
    return unigram.round_trip(table(spark, sf_dir, "documents"), unigram.Unigram.load(tokenizer_path("piece_bpe_32k.model")))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM win) WHERE c >= 2),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(dups.lines, 0) AS n_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dups ON w.doc_id = dups.doc_id LEFT JOIN repeats ON w.doc_id = repeats.doc_id
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
f AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
    OR word_chars < 3 * n_words OR word_chars > 12 * n_words AS failed
  FROM b
),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS bad FROM f GROUP BY source),
totals AS (SELECT sum(n) AS total, sum(bad) / sum(n) AS mean, sum(bad * bad / n) AS square FROM hosts),
prior AS (
  SELECT mean, greatest(1.0::DOUBLE, mean * (1 - mean) / greatest(square / total - mean * mean, 1e-6::DOUBLE) - 1) AS weight FROM totals
),
rates AS (
  SELECT source, round((bad + mean * weight) / (n + weight), 9) AS host_rate,
    mean + 3 * sqrt(mean * (1 - mean) / (weight + 1)) AS high
  FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, host_rate,
  NOT base_failed AND NOT (host_rate > 0.5 OR (host_rate > high AND host_rate > 0.25)) AS kept
FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    named = {name.split("_")[0]: name for name in queries()}
    return {named[k[:-4].lower()]: v for k, v in globals().items() if k.startswith("OP") and k.endswith("_SQL")}

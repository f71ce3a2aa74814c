"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import alignment, bpe, exact_dedup, html_main, iblt, langid, license_scan, packing, sharding, simhash, url_filter, warc, whitening
from tessella.session import ship


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all documents, with the ids' checksum in place of the ids."""
    pieces = packing.pack(docs, _tokenizer("word_bpe_49k.json"))
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("item_tokens").alias("doc_tokens"), "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents: dot-product vector bin packing into sequences of 2048 tokens."""
    return packed(_read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all pages: blocks labelled by a bidirectional LSTM."""
    pages = _read(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html_main.main_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents: byte convolutional network fitted outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))))
    return docs.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), langid.language(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents: ids by a table of distinct words, text back by a table of pieces."""
    return bpe.digests(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents: tree merge of digest runs; the largest doc_id stays."""
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"), keep="max")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents: licence texts and notices with coverage and span."""
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all pages: written as WARC records with revisits, and read back."""
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all documents: SimHash of 3-word shingles, links at 3 bits, covering anchors."""
    return simhash.near_components(_read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents: sixteen shards of near equal bytes from sampled splitters."""
    return sharding.shard_by_bytes(_read(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all documents: invertible Bloom lookup sketches of each text and its edited version."""
    return iblt.versions(_read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all embeddings: up to 32 whitened components from an exact scatter matrix. A deviation that is no long is an error."""
    done = whitening.whiten(_read(spark, sf_dir, "embeddings"))
    return done.withColumn("deviation", F.col("deviation").cast("long"))


#: The rules that all URLs are judged by first.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all pages: rules first, then logistic regression on hashed character n-grams."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(url_filter.labelled_table(spark))
    return url_filter.judged(pages, model, URL_RULES).drop("url")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over all documents: two tokenizers aligned by distinct segments, links rated by documents that hold them."""
    return alignment.align(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_html_extraction, op3_language_id, op4_bpe, op5_exact_dedup, op6_license_scan, op7_warc, op8_simhash, op9_sharding, op10_fingerprints, op11_whitening, op12_url_filter, op13_alignment)}

ORACLE_SQL = {
    "op5_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    # Base32 by hand: of each five bits of the SHA-1, out of the two hex digits that hold them.
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (
          SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS keeper,
                 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i // 4 + 1)::INT, 2))::INT >> (3 - 5 * i % 4)::INT) & 31) + 1, 1)), '') AS payload_digest
          FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM d
    """,
}

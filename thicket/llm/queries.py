"""One query an operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import ann, bpe, chat, classifier, licenses, ngram_join, packing, rules, tokenfile, urls
from thicket.llm._words import small_batches
from thicket.storage import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, on whichever machine runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(more), vocabulary("byte_bpe_50k.json")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    found = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), ranks), ranks)
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenfile.write(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), urls.parse_rules(URL_RULES))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.score(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *rules.STATS, "base_failed", "kept", "quality")


#: Documents whose labels train the classifier; the rest is held out.
def _learned_from(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def quality_weights(spark: SparkSession, sf_dir: str):
    return classifier.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _learned_from())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classifier.score(_table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return found.select("doc_id", (~_learned_from()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw": op1_hnsw,
    "op2_lexical_packing": op2_lexical_packing,
    "op3_chat_windows": op3_chat_windows,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_license_scan": op5_license_scan,
    "op6_token_binary": op6_token_binary,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

#: Only an exact operator has the same rows as SQL; the others are held against
#: brute force in tests.
ORACLES: dict[str, str] = {
    "op10_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
    n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
    e AS (SELECT doc_id, unnest(sh) AS x FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 90 * (x.n + y.n - i)),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
    SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n""",
}

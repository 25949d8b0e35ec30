"""The training-data queries by name, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontam, lexical, licenses, lloyd, neardup, normsearch, oracles, packing, preference, quality, secrets, tokenfile, toxicity, urls
from corvane.llm.common import Scratch


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("secrets")
    return found.select("doc_id", s["n_assign"].alias("n_assign"), s["n_access"].alias("n_access"), s["n_hex"].alias("n_hex"), F.sha2(s["base_spans"], 256).alias("base_sha256"), s["spans"].alias("spans"), s["n_linked"].alias("n_linked"))


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the public tokenizers package, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "tokens").path("store")
    tokenfile.write_store(read(spark, sf_dir, "documents"), store, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    back = tokenfile.read_store(spark, store)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~held_out))
    t = F.col("toxicity")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), t["score"].alias("score"), t["predicted"].alias("predicted"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.recognise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = F.col("licence")
    return found.select("doc_id", F.array_join(F.array_sort(of["licences"]), ",").alias("licences"), of["n_matches"].alias("n_matches"), of["n_sentences"].alias("n_sentences"), of["n_known"].alias("n_known"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    leak = F.col("leak")
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", leak["item_id"].alias("item_id"), F.round(leak["question_overlap"], 6).alias("question_overlap"), F.round(leak["answer_overlap"], 6).alias("answer_overlap"))


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.with_rejected(preference.turns_of(read(spark, sf_dir, "conversations")))
    p = F.col("preference")
    spans = lambda name: F.array_join(F.transform(p[name], lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(name)
    found = preference.format_pairs(pairs)
    return found.select("conv_id", p["n_common"].alias("n_common"), p["prompt"].alias("prompt"), p["chosen"].alias("chosen"), p["rejected"].alias("rejected"), spans("chosen_mask"), spans("rejected_mask"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read(spark, sf_dir, "documents"), size=4, percent=80)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normsearch.top(read(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read(spark, sf_dir, "embeddings"), clusters=8, rounds=10, scale=1024, size=64, seed=3)


QUERIES = (op1_secrets, op2_token_files, op3_toxicity, op4_licenses, op5_quality, op6_packing, op7_decontam, op8_preference, op9_urls, op10_neardup, op11_lexical, op12_topk, op13_lloyd)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()

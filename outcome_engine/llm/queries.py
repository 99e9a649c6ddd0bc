"""The queries of this subpackage: thin digests of the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import is_held_out, label_languages, learn_languages
from .licences import scan_licences
from .lines import dedup_lines
from .neardup import near_components
from .packing import pack_documents
from .passages import remove_repeats
from .phrases import collocations
from .repetition import repetition_quality
from .runs import periodic_runs
from .secrets import scan_secrets
from .tables import read, scratch
from .templates import decontaminate
from .urlrules import UrlRule, filter_urls
from .wavelet import read_shards, write_shards

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = (UrlRule("org", "/", "allow"), UrlRule("example.org", "/es/", "block"), UrlRule("example.org", "/en/1", "block"),
             UrlRule("com", "/fr/", "allow"), UrlRule("com", "/de/", "block"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_pieces(docs: DataFrame) -> DataFrame:
    pieces = pack_documents(docs, tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanner gives its spans by start, then kind; lexed ones are counted in ``spans`` only."""
    spans = scan_secrets(read(spark, sf_dir, "documents"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", name), ",").alias("spans"), count("literal"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths: source, language and the id's higher digits stand for directories,
    and the first document of 64 for the LICENSE file of its directory (the first of 4096: of the one above)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    above = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    here = F.concat_ws("/", above, F.expr("doc_id div 64").cast("string"))
    path = F.when(F.col("doc_id") % 4096 == 0, F.concat(above, F.lit("/LICENSE"))).when(F.col("doc_id") % 64 == 0, F.concat(here, F.lit("/LICENSE"))) \
        .otherwise(F.concat(here, F.lit("/doc-"), F.col("doc_id").cast("string")))
    return scan_licences(docs.select("doc_id", "text", path.alias("path")))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "wavelet-shards")
    write_shards(read(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return read_shards(spark, path)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labelled = label_languages(docs, learn_languages(docs), with_runs=False)
    return labelled.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(read(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by hash repeats a stretch of its own words up to its end."""
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string"))).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    docs = docs.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (F.lit(1) + F.expr("(n - a) div (3 + g % 8)")).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n"))
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs(with_planted_runs(read(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return runs.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                       F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_packing, op2_secrets, op3_decontamination, op4_lines, op5_licences, op6_token_ids, op7_minhash, op8_language, op9_urls,
        op10_repetition, op11_periodic_runs, op12_phrases, op13_passages)}

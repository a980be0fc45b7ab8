"""The queries opN_<name>, which apply each operator to its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave.llm import bpe, licenses, ngram_join, packing, pii, quality, simhash, toxicity, warc, wrapper
from bandweave.llm.common import arrow_pass, table, written


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), derive={"ids_crc32": F.crc32("ids")})


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(quality.features(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "quality")
    kept = quality.judged(rows, quality.host_verdicts(rows))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.searched(simhash.chained(table(spark, sf_dir, "documents")))
    found = [simhash.hex_of("fp_hi", "fp_lo").alias("fingerprint"), simhash.hex_of("edited_hi", "edited_lo").alias("edited_fingerprint")]
    return rows.select("doc_id", "n_chars", F.col("edited").alias("edited_sha256"), *found, simhash.likeness("fp", "edited").alias("near_edited"), simhash.likeness("fp", "next").alias("near_next"), "n_within", "least_within")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        codec = bpe.codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for p in parts:
            ids = [x.tolist() for x in codec.encode(p["text"])]
            yield {"doc_id": p["doc_id"], "n_tokens": [*map(len, ids)], "ids_sha256": [sha(",".join(map(codec.text.__getitem__, x))) for x in ids], "decoded_sha256": [sha(codec.decode(x)) for x in ids]}

    return arrow_pass(table(spark, sf_dir, "documents").select("doc_id", "text"), work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", 200)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", "predicted")


def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    said = lambda kept: f"array_join(transform(filter(pii, x -> {kept}), x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(pii, x -> x.base and x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.expr(f"sha2({said('x.base')}, 256)").alias("base_sha256"), F.expr(said("true")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_licenses, op3_warc, op4_quality, op5_simhash, op6_bpe, op7_ngram_join, op8_toxicity, op9_wrapper, op10_pii)}
ORACLE: dict[str, str] = {"op3_warc": warc.ORACLE, "op4_quality": quality.ORACLE}

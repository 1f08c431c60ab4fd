"""The queries of the operators, by name; each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode, grammar, htmltext, jaccard, langid, linededup, linkgraph, packing, phrases, pii, quality, resample, shared, sql, suffix, winnow


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    return packing.packed(docs, encode.public_path("byte_bpe_50k.json"), end=0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.judged(shared.documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("r.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(shared.documents(spark, sf_dir, "pages"))


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    files = shared.new_path(spark, "token-ids")
    grammar.write(docs, files, encode.public_path("word_bpe_49k.json"), end=1, first_rule=49_408)
    return grammar.read(files, spark)


#: The rules that the query is judged by.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judged(shared.documents(spark, sf_dir, "pages"), URL_RULES).drop("distrust_share")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality.judged(docs).select("r.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.removed(shared.documents(spark, sf_dir).select("doc_id", "text"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut may fall inside a character
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("kept_text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(shared.documents(spark, sf_dir, "pages"), shared.documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    found = winnow.judged(docs, shared.documents(spark, sf_dir, "benchmark"))
    return found.select("r.doc_id", *winnow.FIELDS.names)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(shared.documents(spark, sf_dir).select("doc_id", "text"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.found(shared.documents(spark, sf_dir).select("doc_id", "text"))
    mark = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, mark), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("r.doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(shared.documents(spark, sf_dir).select("text", "lang"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = shared.documents(spark, sf_dir).select("doc_id", "text"), shared.documents(spark, sf_dir, "benchmark")
    return resample.resampled(docs, target).select("r.doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_html_extraction, op4_token_id_output, op5_url_filters, op6_quality_rules, op7_suffix_array_dedup, op8_language_id, op9_decontamination, op10_ngram_jaccard_join, op11_pii, op12_phrase_mining, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filters": sql.op5(URL_RULES), "op9_decontamination": sql.OP9, "op10_ngram_jaccard_join": sql.OP10, "op12_phrase_mining": sql.OP12, "op13_importance_resampling": sql.OP13}

"""One query per operator, over whole tables, and their SQL where it can say the same."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import oracle
from twinsieve.llm.decontaminate import contamination, is_contaminated
from twinsieve.llm.license_scan import license_scan, usual_licenses
from twinsieve.llm.lm_scoring import lm_scores
from twinsieve.llm.mixing import mix_sources, word_count
from twinsieve.llm.near_dups import near_duplicates
from twinsieve.llm.prefix_trie import as_paths, conversations, prefix_trie, rebuilt
from twinsieve.llm.quality_classifier import ACCEPT_AT, fit_classifier, quality_score
from twinsieve.llm.quality_rules import quality_rules
from twinsieve.llm.secret_scan import RULES, secret_spans, spans_text
from twinsieve.llm.sharding import shuffled_shards
from twinsieve.llm.spelling_variants import document_words, spelling_variants
from twinsieve.llm.suffix_dedup import remove_repeats
from twinsieve.llm.token_counts import token_counts

TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def secrets(spark, sf_dir):
    found = secret_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        F.col("_id").alias("doc_id"),
        *[count(rank).alias(f"n_{RULES[rank].kind}") for rank in range(3)],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def shards(spark, sf_dir):
    """`rows`: the counts of two shards differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    return shuffled_shards(documents(spark, sf_dir)).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def near_dups(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir), words=2, percent=80)
    kept = F.col("_id").eqNullSafe(F.col("component_id"))
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


# Production weights; names not listed have weight 1.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}


def domain_of(source: str) -> Column:
    """Domains of the test sources: their number modulo 4, or 'other'."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    known = F.concat(F.lit("domain"), (number % 4).cast("string"))
    return F.coalesce(known, F.lit("other"))


def listed(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, weight).otherwise(out)
    return out


def tree() -> dict[str, Column]:
    return {
        "domain": listed("_domain", DOMAIN_WEIGHTS),
        "lang": listed("_lang", LANG_WEIGHTS),
        "source": F.lit(1),
    }


def mixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    taken = mix_sources(docs, domain_of("source"), tree())
    return taken.select(
        "doc_id",
        domain_of("source").alias("domain"),
        "lang",
        "source",
        word_count(F.col("text")).alias("n_words"),
        F.col("mix_epoch").alias("epoch"),
        F.col("mix_budget").alias("leaf_budget"),
    )


def benchmark_hits(spark, sf_dir):
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def licenses(spark, sf_dir):
    found = license_scan(documents(spark, sf_dir), usual_licenses(spark))
    return found.withColumnRenamed("_id", "doc_id")


def tokens(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    counted = token_counts(documents(spark, sf_dir), model)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def held_out(key: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 2, F.lit(False))


def rules(spark, sf_dir):
    found = quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("_id", "doc_id").drop("probability")


def classifier(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = fit_classifier(docs, labels, learn=~held_out("doc_id", 4))
    scored = docs.select("doc_id", quality_score(model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        held_out("doc_id", 4).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT_AT).cast("int").alias("predicted"),
    )


def lm(spark, sf_dir):
    scores = lm_scores(documents(spark, sf_dir), learn=~held_out("doc_id", 7))
    return scores.select(
        F.col("_id").alias("doc_id"),
        held_out("_id", 7).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def repeats(spark, sf_dir):
    found = remove_repeats(documents(spark, sf_dir))
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def variants(spark, sf_dir):
    return spelling_variants(document_words(documents(spark, sf_dir)))


def trie(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(as_paths(rebuilt(conversations(turns))))


QUERIES = {
    "op1_secret_scan": secrets,
    "op2_shards": shards,
    "op4_near_dups": near_dups,
    "op3_quality_rules": rules,
    "op5_mixing": mixed,
    "op6_decontamination": benchmark_hits,
    "op7_quality_classifier": classifier,
    "op8_token_counts": tokens,
    "op9_license_scan": licenses,
    "op10_lm_scores": lm,
    "op11_suffix_dedup": repeats,
    "op12_spelling_variants": variants,
    "op13_prefix_trie": trie,
}
ORACLE = {
    "op1_secret_scan": oracle.SECRETS,
    "op5_mixing": oracle.mixing_sql(DOMAIN_WEIGHTS, LANG_WEIGHTS),
    "op6_decontamination": oracle.CONTAMINATION,
    "op9_license_scan": oracle.LICENSES,
}

"""The queries of the training-data operators, one for each, and their SQL.

Each applies its operator to the whole table with production parameters and derives
the digest columns of its result. SQL is given where it can express the result in
reasonable time on whole tables; the others are tested against brute force.
"""

from __future__ import annotations

import re
import secrets
import uuid
import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import encode, fingerprint, host_rules, jaccard, language, licenses, mixing, periods, pii, quality, repair, substrings, wavelet
from helixframe.llm.common import shared_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SECRET_SETTING = "spark.helixframe.pii.secret"  # Spark hides settings with "secret" in their names
_random_keys: dict[str, str] = {}  # by application


def secret(spark: SparkSession) -> str:
    """The key of pseudonyms from the session's settings.

    Where it is unset and Spark runs on one machine, as in tests, a public one stands for it. With a public
    key anybody can undo the pseudonyms, so on a cluster a random one is made, which is kept nowhere: equal
    values meet within one application, but not in what another one writes.
    """
    key = spark.conf.get(SECRET_SETTING, None)
    if key:
        return key
    if re.match(r"local(\[|-cluster\[|$)", spark.sparkContext.master):
        return "no secret is set"
    application = spark.sparkContext.applicationId
    if application not in _random_keys:
        warnings.warn(f"{SECRET_SETTING} is unset: pseudonyms hold for this application only", stacklevel=2)
    return _random_keys.setdefault(application, secrets.token_hex(32))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.bpe_round_trip(documents(spark, sf_dir), TOKENIZER)


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), secret(spark), counts="n_replaced")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_quality(documents(spark, sf_dir)).drop("host_rate")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    wavelet.write_token_files(documents(spark, sf_dir), path, TOKENIZER)
    return wavelet.read_token_files(spark, path)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir)).drop("copies")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(documents(spark, sf_dir))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(documents(spark, sf_dir), damage=True)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.conversation_repairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"), damage=True)


def queries() -> dict:
    own = (op1_bpe_automaton, op2_pii_pseudonyms, op3_host_rules, op4_jaccard_join, op5_substring_dedup, op6_wavelet_tokens, op7_source_mix, op8_quality_classifier, op9_license_scan, op10_fingerprints, op11_language_id, op12_periodic_runs, op13_conversation_repair)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_host_rules": host_rules.QUALITY_SQL, "op7_source_mix": mixing.PLAN_SQL, "op13_conversation_repair": repair.REPAIRS_SQL}

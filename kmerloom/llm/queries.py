"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from kmerloom.llm import alignment, centroids, decontaminate, mixing, pii, repeats, sharding, simhash, token_files, toxicity, urlfilter, warc, winnow
from kmerloom.llm.tables import table

QUERIES = {
    "op1_decontaminate_cgk": lambda spark, d: decontaminate.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_mix_temperature": lambda spark, d: mixing.query(table(spark, d, "documents")),
    "op3_pii_information": lambda spark, d: pii.query(table(spark, d, "documents")),
    "op4_shard_bytes": lambda spark, d: sharding.query(table(spark, d, "documents")),
    "op5_winnow": lambda spark, d: winnow.query(table(spark, d, "documents")),
    "op6_suffix_passes": lambda spark, d: repeats.query(table(spark, d, "documents")),
    "op7_simhash_anchors": lambda spark, d: simhash.query(table(spark, d, "documents")),
    "op8_url_asof": lambda spark, d: urlfilter.query(table(spark, d, "pages")),
    "op9_toxicity_lexicon": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_warc_salvage": lambda spark, d: warc.query(table(spark, d, "pages")),
    "op11_centroid_dictionary": lambda spark, d: centroids.query(table(spark, d, "embeddings")),
    "op12_token_files": lambda spark, d: token_files.query(table(spark, d, "documents")),
    "op13_align_tokenizers": lambda spark, d: alignment.query(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {"op8_url_asof": urlfilter.SQL, "op10_warc_salvage": warc.SQL, "op11_centroid_dictionary": centroids.SQL}

"""The registered queries of this subpackage, thin layers over its operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, jaccard_join, packing, pseudonyms, quality, secrets, sentence_pieces, sharding, substring_dedup, suffix_dedup, toxicity, whitening
from .store import ensure_session, shared_folder


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine; TIDAL_TOKENIZERS names another folder."""
    if own := os.environ.get("TIDAL_TOKENIZERS"):
        return f"{own}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("span_list")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session's setting; the one given here is for synthetic tables only."""
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get("spark.tidal.pseudonyms.key", "key of the synthetic tables"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.mark_repeats(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from a compacted store, with a digest of their text."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.shard_documents(docs, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    return store.read().select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_sentence_pieces": op13_sentence_pieces,
}

_WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB equivalents, where SQL expresses a whole query.
ORACLES: dict[str, str] = {
    "op5_substring_dedup": f"""
        WITH W AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
        H AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM W WHERE len(w) >= 35)),
        D AS (SELECT h FROM H GROUP BY h HAVING count(*) > 1),
        G AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(generate_series(0, 34)) AS j FROM H JOIN D USING (h))),
        V AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM W),
        K AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM V ANTI JOIN G USING (doc_id, i) GROUP BY doc_id)
        SELECT W.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM W LEFT JOIN K ON W.doc_id = K.doc_id""",
    "op8_jaccard_join": f"""
        WITH RECURSIVE W AS (SELECT doc_id, {_WORDS.format(t=f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
        S AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM W WHERE len(w) > 0)),
        N AS (SELECT doc_id, count(*) AS n FROM S GROUP BY 1),
        C AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM S a JOIN S b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        L AS (SELECT x, y FROM C JOIN N a ON a.doc_id = x JOIN N b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        E AS (SELECT x, y FROM L UNION ALL SELECT y, x FROM L),
        R AS (SELECT doc_id AS d, doc_id AS r FROM W UNION SELECT d, y FROM R JOIN E ON x = r)
        SELECT W.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM W JOIN R ON d = W.doc_id LEFT JOIN N ON N.doc_id = W.doc_id GROUP BY 1""",
    "op9_sharding": "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents",
}

"""Queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, budget, garbled, mixing, pairs, splitting, transcripts
from lodestone.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.find_defects(table(spark, sf, "eval_results"), table(spark, sf, "documents").select("text", "lang"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized(table(spark, sf, "chunks"), table(spark, sf, "source_limits"))


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf, "chunks"), table(spark, sf, "source_limits"))


def p3_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return budget.token_budget(table(spark, sf, "chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.speaker_turns(table(spark, sf, "transcript_lines"), table(spark, sf, "speaker_roster"), with_text=False)


def p5_turns(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.speaker_turns(table(spark, sf, "transcript_lines"), table(spark, sf, "speaker_roster"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf, "documents"))


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text decoded from its ids again: (doc_id, text_md5)."""
    return bpe.decode_ids(p6_ids(spark, sf)).select("doc_id", F.md5("text").alias("text_md5"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture_shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.find_garbled(table(spark, sf, "documents")).select("doc_id", "restored_md5")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_pieces, p3_token_budget, p5_found, p5_turns, p6_ids, p6_round_trip, p7_mixture, p7_shares, p8_found)
}

SQL: dict[str, str] = {
    "p2_found": r"""
        WITH l AS (SELECT lower(trim(data_source)) AS source, max_chars FROM source_limits),
        c AS (SELECT chunk_id, chunk, coalesce((SELECT min(max_chars) FROM l WHERE l.source = regexp_replace(lower(data_source), '^\s+|\s+$', '', 'g')),
                                               (SELECT min(max_chars) FROM l WHERE l.source = 'default')) AS most FROM chunks)
        SELECT chunk_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(chunk, '[\p{L}\p{N}]+'), lambda x: length(x))), 0) > most AS INTEGER) AS forced_cut
        FROM c WHERE length(chunk) > most""",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
}

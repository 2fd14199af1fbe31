"""Driver queries of the training-data operators; SQL where SQL can express them."""

from __future__ import annotations

from riskframe.llm import (
    alignment,
    chat,
    decontam,
    embeddings,
    fingerprints,
    html,
    langid,
    linededup,
    pieces,
    sharding,
    simhash,
    tokenfile,
    trie,
)
from riskframe.llm.common import read

QUERIES = {
    "op1_language_id": lambda spark, folder: langid.identify_documents(read(spark, folder, "documents")),
    "op2_decontamination": lambda spark, folder: decontam.contaminated(
        read(spark, folder, "documents"), read(spark, folder, "benchmark")),
    "op3_sharding": lambda spark, folder: sharding.shard_documents(read(spark, folder, "documents")),
    "op4_sentencepiece": lambda spark, folder: pieces.encode_documents(read(spark, folder, "documents")),
    "op5_fingerprints": lambda spark, folder: fingerprints.fingerprint_documents(
        read(spark, folder, "documents")),
    "op6_simhash": lambda spark, folder: simhash.near_duplicates(read(spark, folder, "documents")),
    "op7_chat_format": lambda spark, folder: chat.chat_query(spark, read(spark, folder, "conversations")),
    "op8_line_dedup": lambda spark, folder: linededup.line_dedup_query(read(spark, folder, "documents")),
    "op9_token_file": lambda spark, folder: tokenfile.token_file(read(spark, folder, "documents")),
    "op10_html_extraction": lambda spark, folder: html.extract_pages(read(spark, folder, "pages")),
    "op11_token_alignment": lambda spark, folder: alignment.align_documents(read(spark, folder, "documents")),
    "op12_prefix_trie": lambda spark, folder: trie.prefix_trie(read(spark, folder, "conversations")),
    "op13_embedding_dedup": lambda spark, folder: embeddings.near_vectors(read(spark, folder, "embeddings")),
}

SQL: dict[str, str] = {"op2_decontamination": decontam.SQL, "op8_line_dedup": linededup.SQL}

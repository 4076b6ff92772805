"""Registered queries of the training-data operators, with production parameters, and their SQL oracles."""

from __future__ import annotations

from lucidframe.llm import bpe, htmltext, jaccard, licenses, media, mixing, pii, quality, vectors, warc
from lucidframe.llm.common import table


def op1_warc_reassembly(spark, sf_dir):
    """Every page, cut into segmented WARC records of chunked responses, put together again."""
    return warc.pages_reassembled(table(spark, sf_dir, "pages"))


def op2_skip_chain_pii(spark, sf_dir):
    """Every document redacted, with its personal data and secrets."""
    return pii.redact(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_nbsvm_quality(spark, sf_dir):
    """Score of every document by NB-SVM, fitted on a bounded sample of the labelled ones, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", "score", "keep")


def op4_license_scan(spark, sf_dir):
    """Every licence notice in every document, within bounded edits."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_bpe(spark, sf_dir):
    """Token ids of every document, and the text decoded from them."""
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), decode=True)


def op6_html_density(spark, sf_dir):
    """Main text of every page."""
    return htmltext.html_text(table(spark, sf_dir, "pages"))


def op7_media_tiles(spark, sf_dir):
    """Tile and hash of an image made of each document's bytes."""
    return media.media_columns(media.documents_as_images(table(spark, sf_dir, "documents")))


def op8_poisson_mix(spark, sf_dir):
    """Documents replicated to source weights of rows ** 0.5 and shuffled."""
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op9_subspace_near_vectors(spark, sf_dir):
    """Class and number of links of every embedding, over links of cosine 0.975 or more."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_jaccard_join(spark, sf_dir):
    """Class and number of links of every document, over links of Jaccard 0.5 or more between word 3-gram sets."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc_reassembly": op1_warc_reassembly,
    "op2_skip_chain_pii": op2_skip_chain_pii,
    "op3_nbsvm_quality": op3_nbsvm_quality,
    "op4_license_scan": op4_license_scan,
    "op5_bpe": op5_bpe,
    "op6_html_density": op6_html_density,
    "op7_media_tiles": op7_media_tiles,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_subspace_near_vectors": op9_subspace_near_vectors,
    "op10_jaccard_join": op10_jaccard_join,
}
ORACLE_SQL = {
    "op1_warc_reassembly": warc.ORACLE_SQL,
    "op8_poisson_mix": mixing.ORACLE_SQL,
    "op9_subspace_near_vectors": vectors.ORACLE_SQL,
    "op10_jaccard_join": jaccard.oracle_sql(),
}

"""Queries of the training-data operators, registered by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import cooccur, knn, leak, mix, provenance, secrets, shared_spans, split, unparsed
from lodestrata.llm.oracles import ORACLES
from lodestrata.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _scanned(s: SparkSession, d: str) -> DataFrame:
    return secrets.scan(secrets.records(table(s, d, "chunks"), table(s, d, "vector_records")))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: unparsed.unparsed(table(s, d, "source_files")),
        "p1_errors": lambda s, d: unparsed.parsed(table(s, d, "source_files")),
        "p1_rates": lambda s, d: unparsed.acceptance(table(s, d, "source_files")),
        "p2_found": lambda s, d: provenance.not_handwritten(table(s, d, "source_files"), table(s, d, "chunks")),
        "p2_labels": lambda s, d: provenance.labelled(table(s, d, "source_files"), table(s, d, "chunks")).select("repo", "path", "label", "probability"),
        "p3_found": lambda s, d: secrets.lines(_scanned(s, d)),
        "p3_redacted": lambda s, d: secrets.redacted(_scanned(s, d)),
        "p4_found": lambda s, d: split.split_oversized(table(s, d, "chunks"), with_text=False).select("chunk_id").distinct(),
        "p4_pieces": lambda s, d: split.split_oversized(table(s, d, "chunks"), with_text=False),
        "p5_found": lambda s, d: cooccur.associated(table(s, d, "commit_nodes")),
        "p5_pairs": lambda s, d: cooccur.cooccurrence(table(s, d, "commit_nodes"), min_count=1),
        "p6_found": lambda s, d: knn.alike(table(s, d, "vector_records")),
        "p6_top5": lambda s, d: knn.nearest(table(s, d, "vector_records")),
        "p6_search": lambda s, d: knn.nearest(table(s, d, "vector_records"), query_mod=20).withColumn("cosine", F.round("cosine", 6)),
        "p7_found": lambda s, d: leak.leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id"),
        "p7_leaks": lambda s, d: leak.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p7_clean": lambda s, d: leak.cleaned(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_taken": lambda s, d: mix.taken(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_report": lambda s, d: mix.report(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_found": lambda s, d: shared_spans.sharing_pairs(table(s, d, "documents")),
        "p9_passages": lambda s, d: shared_spans.passages(table(s, d, "documents")),
        "p9_shared": lambda s, d: shared_spans.shared_share(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

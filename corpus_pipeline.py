"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, source mix, packing."""

from cadenza.llm import lines, mixing, ngram_join, packing, quality
from cadenza.llm.common import cut, table

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", lines.stage),
    ("ngram_join", ngram_join.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Packing and dependent rounding have no SQL form; tests compare each stage with a plain Python version.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The stages over documents, each one's rows written to the checkpoint folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs

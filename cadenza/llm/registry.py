"""The queries of this subpackage and the SQL that gives the same rows."""

from . import cutting_stock, embeddings, infilling, licenses, lines, mixing, ngram_join, packing, periodic, quality, secrets, toxicity, urls
from .oracle import SQL

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_packing": packing.op2_packing,
    "op3_embedding_dedup": embeddings.op3_embedding_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_url_filters": urls.op6_url_filters,
    "op7_license_scans": licenses.op7_license_scans,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_fill_in_middle": infilling.op12_fill_in_middle,
    "op13_cutting_stock": cutting_stock.op13_cutting_stock,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return {k: v for k, v in SQL.items() if k in QUERIES}

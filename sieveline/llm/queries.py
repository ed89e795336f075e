"""The corpus queries for __spark_entry__.py: each applies its operator to the whole of its table."""

from __future__ import annotations

import importlib

from .common import read_table

#: query -> (module, function, table)
_OPS = {
    "op1_warc_derivatives": ("warc", "op1", "pages"),
    "op2_collinear_chaining": ("passages", "op2", "documents"),
    "op3_bounded_ring": ("ring", "op3", "documents"),
    "op4_best_fit_packing": ("packing", "op4", "documents"),
    "op5_nnpu_toxicity": ("toxicity", "op5", "documents"),
    "op6_jaccard_regions": ("jaccard", "op6", "documents"),
    "op7_vantage_point_trees": ("vptree", "op7", "embeddings"),
    "op8_imatch": ("imatch", "op8", "documents"),
    "op9_systematic_mixing": ("mixing", "op9", "documents"),
    "op10_license_paragraphs": ("licenses", "op10", "documents"),
    "op11_trie_variants": ("spelling", "op11", "documents"),
    "op12_louds_tries": ("tries", "op12", "conversations"),
    "op13_line_dedup": ("lines", "op13", "documents"),
}


def queries() -> dict:
    def query(module: str, function: str, table: str):
        def run(spark, sf_dir):
            f = getattr(importlib.import_module(f"{__package__}.{module}"), function)
            more = (read_table(spark, sf_dir, "labels"),) if function == "op5" else ()
            return f(read_table(spark, sf_dir, table), *more)

        return run

    return {name: query(*how) for name, how in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    from .lines import OP13_SQL
    from .mixing import OP9_SQL
    from .spelling import OP11_SQL
    from .tries import OP12_SQL
    from .vptree import OP7_SQL

    return {"op7_vantage_point_trees": OP7_SQL, "op9_systematic_mixing": OP9_SQL, "op11_trie_variants": OP11_SQL, "op12_louds_tries": OP12_SQL, "op13_line_dedup": OP13_SQL}

"""The queries of this folder, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, lexical, merkle, topk
from tickloom.llm.decontaminate import op10_decontaminate
from tickloom.llm.html_text import op7_html_text
from tickloom.llm.language import op9_language
from tickloom.llm.lexical import op12_lexical_search
from tickloom.llm.merkle import op13_merkle_manifest
from tickloom.llm.near_dedup import op8_near_dedup
from tickloom.llm.packing import op4_packing
from tickloom.llm.permutation import op11_permutation_index
from tickloom.llm.secrets import op3_secret_scan
from tickloom.llm.substring_dedup import op2_substring_dedup
from tickloom.llm.suffix_dedup import op1_suffix_dedup
from tickloom.llm.token_files import op6_token_files
from tickloom.llm.topk import op5_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_substring_dedup,
        op3_secret_scan,
        op4_packing,
        op5_topk,
        op6_token_files,
        op7_html_text,
        op8_near_dedup,
        op9_language,
        op10_decontaminate,
        op11_permutation_index,
        op12_lexical_search,
        op13_merkle_manifest,
    )
}
ORACLES: dict[str, str] = {"op5_topk": topk.SQL, "op10_decontaminate": decontaminate.SQL, "op12_lexical_search": lexical.SQL, "op13_merkle_manifest": merkle.SQL}

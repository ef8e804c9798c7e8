"""Registered queries of this subpackage, and SQL where it can say the same; models, coders, tokenizers and hashes it can't: tests hold those against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontaminate, merkle, phrases, secrets, topk
from marginalia.llm.counts import op8
from marginalia.llm.decontaminate import op4
from marginalia.llm.language import op10
from marginalia.llm.merkle import op11
from marginalia.llm.neighbours import op7
from marginalia.llm.packing import op9
from marginalia.llm.phrases import op12
from marginalia.llm.pii import op5
from marginalia.llm.rangecoder import op2
from marginalia.llm.secrets import op3
from marginalia.llm.simhash import op6
from marginalia.llm.topk import op13
from marginalia.llm.toxicity import op1


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1,
        "op2_token_binary": op2,
        "op3_secrets": op3,
        "op4_decontamination": op4,
        "op5_pii": op5,
        "op6_simhash": op6,
        "op7_neighbours": op7,
        "op8_token_counts": op8,
        "op9_packing": op9,
        "op10_language": op10,
        "op11_merkle": op11,
        "op12_phrases": op12,
        "op13_topk": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": secrets.SQL, "op4_decontamination": decontaminate.SQL, "op11_merkle": merkle.SQL, "op12_phrases": phrases.SQL, "op13_topk": topk.SQL}

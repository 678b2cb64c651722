"""All queries of this subpackage and of the corpus pipeline, and the SQL they must agree with."""

from __future__ import annotations

import corpus_pipeline
from tremorline.llm import chat, decontaminate, divergence, fingerprint, infill, mixing, quality, repeats, sharding, simhash, templates, topk, toxicity  # noqa: F401
from tremorline.llm.common import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

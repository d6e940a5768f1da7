"""The queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from cubegraph.llm import alignment, exact_dedup, hidden_markov, jaccard_join, languages, licences, mixing, packing, personal, quality, runs, warc, wrappers  # noqa: F401
from cubegraph.llm.base import REGISTERED, LlmQuery


def llm_queries() -> dict[str, LlmQuery]:
    return dict(REGISTERED)

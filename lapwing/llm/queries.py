"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from lapwing.llm import chat, decontam, digestruns, langid, licenses, merkle, mixing, neighbours, packing, partenum, quality, resampling, secrets

_MODULES = (secrets, quality, packing, neighbours, decontam, mixing, langid, licenses, chat, partenum, merkle, digestruns, resampling)


def queries() -> dict[str, Callable]:
    import corpus_pipeline

    return {k: v for m in _MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}

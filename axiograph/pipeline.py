"""Chains of steps on one ontology, and a registry of steps of one's own."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from axiograph.model import Ontology
from axiograph.operators import reason, repair, setops

Step = Callable[..., DataFrame]
_STEPS: dict[str, Step] = {}
_log = logging.getLogger(__name__)


def register(name: str, step: Step) -> None:
    """step(ontology, **options) -> triples; a name is taken once."""
    if name in _STEPS:
        raise ValueError(f"step {name} exists")
    _STEPS[name] = step


def registered() -> list[str]:
    return sorted(_STEPS)


register("merge", lambda ont, others: setops.merge(ont.rows, *others))
register("unmerge", lambda ont, others: setops.unmerge(ont.rows, *others))
register("rename", lambda ont, mapping: setops.rename(ont.rows, mapping))
register("rename-prefixes", lambda ont, prefixes: setops.rename_prefixes(ont.rows, prefixes))
register("annotate", setops.annotate)
register("repair", repair.repair_references)
register("reason", reason.reasoned)


class Chain:
    """Chain(triples).then("rename", ...).then(...).triples: each step gets what the one before made."""

    def __init__(self, triples: DataFrame):
        self.triples = triples

    def then(self, name: str, **options: object) -> Chain:
        if name not in _STEPS:
            raise ValueError(f"unknown step {name}; known: {', '.join(registered())}")
        began = time.monotonic()
        out = Chain(_STEPS[name](Ontology(self.triples), **options))
        _log.info("%s planned in %.2f s", name, time.monotonic() - began)
        return out

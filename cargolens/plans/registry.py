"""All registered queries and their check SQL, by operator."""

from __future__ import annotations

import importlib

from cargolens.session import tune

FAMILIES = ["shipment", "validation", "merging", "output", "texts", "editing", "scoring", "lifecycle", "extracting"]


def _entries() -> dict:
    out: dict = {}
    for family in FAMILIES:
        module = importlib.import_module(f"cargolens.plans.{family}")
        repeated = out.keys() & module.QUERIES.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        out.update(module.QUERIES)
    return out


def _tuned(build):
    def run(spark, sf_dir):
        return build(tune(spark), sf_dir)

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    return run


def queries() -> dict:
    return {name: _tuned(build) for name, (build, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _entries().items() if text is not None}

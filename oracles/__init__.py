"""Independent SQL for the registered queries, run by DuckDB on the same tables."""

from oracles import evaluation, labels, model, quality
from tracewright.catalog import TASKS
from tracewright.plans.queries import SEGMENTED


def all_oracles() -> dict[str, str]:
    sql = {"label_" + key.lower().replace("-", "_"): labels.single(key, "P0", "purchase")
           for key in TASKS}
    sql["labels_orders_wide"] = labels.wide("S0", "N")
    sql["labels_source_wide"] = labels.source_wide("S0", "N")
    sql["labels_every_parameter"] = labels.every_parameter(["P0", "P1", "P2", "P3"], ["purchase"])
    sql = {**sql, **model.oracles(), **quality.oracles(), **evaluation.oracles()}
    return sql | {f"{name}_segmented": sql[name] for name in SEGMENTED}

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from cellarbook.plans.catalog import QUERIES
from cellarbook.session import local_session

HEADLINE = (
    "gold_fct_ventas_items",
    "gold_dim_producto",
    "gold_fct_consumo_insumos_a_todos",
    "gold_fct_pedidosya_items",
    "gold_fct_ventas_b_pedidosya",
    "gold_dim_promedio_peso_porcion_a",
    "gold_fct_reconciliacion_bebidas_a",
    "gold_fct_reconciliacion_bebidas_a_diario",
    "gold_fct_reconciliacion_insumos_a",
    "gold_fct_reconciliacion_bebidas_b",
    "gold_fct_reconciliacion_bebidas_b_diario",
    "gold_fct_reconciliacion_insumos_b",
    "gold_fct_ventas_diarias_negocio",
    "gold_fct_gastos_compilados",
    "gold_fct_estados_resultados",
    "sales_pivot_sum",
    "sales_pivot_per_day",
    "pnl_month_pivot",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    # One query first, so that starting the session is not charged to the first headline.
    QUERIES["gold_dim_producto"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

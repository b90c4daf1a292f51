"""The local session of tests and checks."""

from __future__ import annotations

import tempfile

from callsift.session import build_session


def local_session(cpus: int = 8):
    warehouse = tempfile.mkdtemp(prefix="callsift-warehouse-")
    spark = build_session(
        "callsift-tests",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": warehouse,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

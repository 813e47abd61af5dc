"""Adapters between many models: a keyed table of maps, read as a graph, and the map along its cheapest path.

With models A, B and C and maps from C to B and from B to A, vectors of C can be searched in a collection of A at once. A path costs what it may be wrong by: each step
stretches the error of the steps before by its gain and adds its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.operators.adapter import Adapter, Affine
from loomvec.sources.keyed import KeyedTable
from loomvec.sources.schemas import ADAPTERS


class AdapterBook:
    """Maps by (from_model, to_model); a newer one takes an older one's place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, KeyedTable(spark, path, ADAPTERS, ["from_model", "to_model"])

    def put(self, from_model: str, to_model: str, adapter: Affine | Adapter) -> None:
        """Keep a map from ``from_model``'s space to ``to_model``'s. A rotation is a map without offset, and with an error of 0 as none is known."""
        if isinstance(adapter, Adapter):
            adapter = Affine(adapter.r, np.zeros(len(adapter.r)), adapter.rank, 0.0)
        a = np.asarray(adapter.a, np.float64)
        row = {"from_model": from_model, "to_model": to_model, "n_out": len(a), "n_in": a.shape[1], "matrix": bytearray(a.tobytes()), "shift": bytearray(np.asarray(adapter.b, np.float64).tobytes()), "rank": int(adapter.rank), "error": float(adapter.error), "gain": adapter.gain}
        self.table.upsert(self.spark.createDataFrame([tuple(row[f.name] for f in ADAPTERS)], ADAPTERS), unique=True)

    def get(self, from_model: str, to_model: str) -> Affine:
        r = self.table.read().where((F.col("from_model") == from_model) & (F.col("to_model") == to_model)).first()
        if r is None:
            raise ValueError(f"no adapter from {from_model!r} to {to_model!r}")
        return Affine(np.frombuffer(r["matrix"]).reshape(r["n_out"], r["n_in"]), np.frombuffer(r["shift"]), r["rank"], r["error"])

    def routes(self, from_model: str) -> DataFrame:
        """(to_model, route, error): for every model that can be reached, the models of the cheapest path to it and a bound on its error.

        A round joins the paths found so far with the maps and keeps each model's cheapest (fewest steps, then by name, on ties); a path over all models has no more
        steps than there are, so rounds end.
        """
        steps = self.table.read().select(F.col("from_model").alias("at"), "to_model", F.col("error").alias("own"), "gain")
        best = lambda rows: rows.groupBy("to_model").agg(F.min(F.struct("error", F.size("route").alias("steps"), "route")).alias("b")).select("to_model", "b.route", "b.error")
        found = steps.where(F.col("at") == from_model).select("to_model", F.array("at", "to_model").alias("route"), F.col("own").alias("error"))
        found, known = best(found), None
        while known != (known := sorted(map(tuple, found.select("to_model", F.concat_ws("\n", "route")).collect()))):  # a row for each model
            here = self.spark.createDataFrame([(m, r.split("\n")) for m, r in known], "to_model string, route array<string>").join(found.select("to_model", "error"), "to_model")
            on = here.withColumnRenamed("to_model", "at").join(steps, "at").where(~F.array_contains("route", F.col("to_model")))
            on = on.select("to_model", F.concat("route", F.array("to_model")).alias("route"), (F.col("gain") * F.col("error") + F.col("own")).alias("error"))
            found = best(here.select("to_model", "route", "error").union(on))
            found = self.spark.createDataFrame(found.collect(), found.schema)  # a row for each model
        return found

    def chained(self, from_model: str, to_model: str) -> tuple[list[str], Affine]:
        """The cheapest path's models and its steps as one map."""
        row = self.routes(from_model).where(F.col("to_model") == to_model).first()
        if row is None:
            raise ValueError(f"no chain of adapters leads from {from_model!r} to {to_model!r}")
        route = row["route"]
        whole = self.get(*route[:2])
        for step in zip(route[1:], route[2:]):
            whole = self.get(*step).after(whole)
        return route, whole

"""Embedding-lifecycle engine for PySpark: content-addressed embedding, change-feed refresh and model migration as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from loomvec.operators.adapter import Adapter  # noqa: E402
from loomvec.operators.evaluate import AdapterQualityError  # noqa: E402
from loomvec.plans.embed import EmbedRun, embed  # noqa: E402
from loomvec.plans.ledger import Ledger  # noqa: E402
from loomvec.plans.migrate import MigrateRun, migrate  # noqa: E402
from loomvec.plans.watch import WatchRun, watch  # noqa: E402

__all__ = ["Adapter", "AdapterQualityError", "EmbedRun", "Ledger", "MigrateRun", "WatchRun", "embed", "migrate", "watch"]

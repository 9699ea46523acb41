from workload import feature_queries, model_queries, sequence_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401

"""Small textbook networks with their published numbers, and data drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.models.networks import BayesianNetwork
from tessera.models.tables import CPD

# The published tables. A binary variable's number is its probability
# of state 1 for each configuration of parents, the first parent the slowest.
BINARY: dict[str, dict[str, tuple[list[str], list[float]]]] = {
    "asia": {
        "asia": ([], [0.01]), "smoke": ([], [0.5]), "tub": (["asia"], [0.01, 0.05]), "lung": (["smoke"], [0.01, 0.1]), "bronc": (["smoke"], [0.3, 0.6]),
        "either": (["lung", "tub"], [0, 1, 1, 1]), "xray": (["either"], [0.05, 0.98]), "dysp": (["bronc", "either"], [0.1, 0.7, 0.8, 0.9]),
    },
    "cancer": {"Pollution": ([], [0.1]), "Smoker": ([], [0.3]), "Cancer": (["Pollution", "Smoker"], [0.001, 0.03, 0.02, 0.05]), "Xray": (["Cancer"], [0.2, 0.9]), "Dyspnoea": (["Cancer"], [0.3, 0.65])},
    "earthquake": {"Burglary": ([], [0.01]), "Earthquake": ([], [0.02]), "Alarm": (["Burglary", "Earthquake"], [0.001, 0.29, 0.94, 0.95]), "JohnCalls": (["Alarm"], [0.05, 0.9]), "MaryCalls": (["Alarm"], [0.01, 0.7])},
    "sprinkler": {"Cloudy": ([], [0.5]), "Sprinkler": (["Cloudy"], [0.5, 0.1]), "Rain": (["Cloudy"], [0.2, 0.8]), "WetGrass": (["Sprinkler", "Rain"], [0, 0.9, 0.9, 0.99])},
    "dog_problem": {"bowel_problem": ([], [0.01]), "family_out": ([], [0.15]), "dog_out": (["family_out", "bowel_problem"], [0.3, 0.97, 0.9, 0.99]), "light_on": (["family_out"], [0.05, 0.6]), "hear_bark": (["dog_out"], [0.01, 0.7])},
    "coin_toss": {"Coin": ([], [0.5]), "Toss": (["Coin"], [0.5, 0.9])},
}


def network(name: str) -> BayesianNetwork:
    """A network of :func:`names`."""
    if name in BINARY:
        return BayesianNetwork([CPD(v, 2, [[1 - x for x in p], p], ps, [2] * len(ps)) for v, (ps, p) in BINARY[name].items()])
    if name == "student":
        return BayesianNetwork([
            CPD("D", 2, [0.6, 0.4]), CPD("I", 2, [0.7, 0.3]), CPD("G", 3, [[0.3, 0.05, 0.9, 0.5], [0.4, 0.25, 0.08, 0.3], [0.3, 0.7, 0.02, 0.2]], ["I", "D"], [2, 2]),
            CPD("L", 2, [[0.1, 0.4, 0.99], [0.9, 0.6, 0.01]], ["G"], [3]), CPD("S", 2, [[0.95, 0.2], [0.05, 0.8]], ["I"], [2]),
        ])
    if name == "monty_hall":  # the host opens a door that is neither chosen nor the prize's
        opened = [[0.0 if h in (c, p) else 1 / (2 if c == p else 1) for c in range(3) for p in range(3)] for h in range(3)]
        return BayesianNetwork([CPD("Choice", 3, [1 / 3] * 3), CPD("Prize", 3, [1 / 3] * 3), CPD("Host", 3, opened, ["Choice", "Prize"], [3, 3])])
    raise KeyError(name)


def names() -> list[str]:
    return sorted([*BINARY, "student", "monty_hall"])


def dataset(spark: SparkSession, name: str, rows: int = 1000, seed: int = 0) -> DataFrame:
    """Rows drawn from a network, as strings; no files come with the library."""
    drawn = network(name).simulate(spark, rows, seed)
    return drawn.select(*[F.col(c).cast("string").alias(c) for c in drawn.columns])

"""Sources and sinks: CSV, JSON, HTML text, records, and model files of networks."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row; every value stays text and empty fields are empty texts."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Header and rows, null as an empty field; one file only when asked for."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects: the union of keys, sorted, whole numbers as double."""
    df = spark.read.json(path, multiLine=True)
    number = {"bigint", "int", "double"}
    return df.select(*[F.col(c).cast("double").alias(c) if dict(df.dtypes)[c] in number else F.col(c) for c in sorted(df.columns)])


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object for each row, in column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def to_records(df: DataFrame, limit: int) -> list[dict]:
    """Up to ``limit`` rows on the driver."""
    return [r.asDict() for r in df.limit(limit).collect()]


def to_html(df: DataFrame, limit: int = 100) -> str:
    """A table of up to ``limit`` rows."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in df.limit(limit).collect())
    return "<table><tr>" + "".join(cell("th", c) for c in df.columns) + f"</tr>{body}</table>"


class Network:
    """A discrete network: states of each variable, and tables P(variable | parents) as dictionaries of rows."""

    def __init__(self, states: dict[str, list[str]], tables: dict[str, tuple[list[str], dict[tuple, list[float]]]]):
        self.states, self.tables = states, tables

    def edges(self) -> list[tuple[str, str]]:
        return [(p, v) for v, (parents, _) in self.tables.items() for p in parents]

    def check(self) -> bool:
        return all(abs(sum(p) - 1) < 1e-6 and len(p) == len(self.states[v]) for v, (_, rows) in self.tables.items() for p in rows.values())

    def factors(self, spark: SparkSession) -> list[DataFrame]:
        """Each table as a factor (variable, parents..., v)."""
        out = []
        for v, (parents, rows) in self.tables.items():
            cells = [(s, *key, float(p)) for key, ps in rows.items() for s, p in zip(self.states[v], ps, strict=True)]
            out.append(spark.createDataFrame(cells, [v, *parents, "v"]))
        return out


def read_bif(text: str) -> Network:
    """The BIF text format: variable and probability blocks."""
    states, tables = {}, {}
    for name, body in re.findall(r"variable\s+(\S+)\s*\{(.*?\})\s*;?\s*\}", text, re.S):
        states[name] = [s.strip() for s in re.search(r"\{(.*?)\}", body, re.S)[1].split(",")]
    for head, body in re.findall(r"probability\s*\(([^)]*)\)\s*\{(.*?)\}", text, re.S):
        child, _, given = head.partition("|")
        parents = [p.strip() for p in given.split(",") if p.strip()]
        number = lambda x: [float(v) for v in x.split(",")]
        rows = {tuple(s.strip() for s in key.split(",")): number(p) for key, p in re.findall(r"\(([^)]*)\)\s*([^;]+);", body)}
        if not parents:
            rows[()] = number(re.search(r"table\s+([^;]+);", body)[1])
        tables[child.strip()] = (parents, rows)
    return Network(states, tables)


def write_bif(net: Network) -> str:
    out = ["network unknown {\n}\n"]
    for v, s in net.states.items():
        out.append(f"variable {v} {{\n  type discrete [ {len(s)} ] {{ {', '.join(s)} }};\n}}\n")
    for v, (parents, rows) in net.tables.items():
        out.append(f"probability ( {v}{' | ' + ', '.join(parents) if parents else ''} ) {{\n")
        for key, p in rows.items():
            out.append(f"  {'(' + ', '.join(key) + ')' if key else 'table'} {', '.join(map(repr, p))};\n")
        out.append("}\n")
    return "".join(out)


def read_network_json(text: str) -> Network:
    x = json.loads(text)
    return Network(x["states"], {v: (t["parents"], {tuple(r["given"]): r["p"] for r in t["rows"]}) for v, t in x["tables"].items()})


def write_network_json(net: Network) -> str:
    return json.dumps({"states": net.states, "tables": {v: {"parents": p, "rows": [{"given": list(k), "p": x} for k, x in rows.items()]} for v, (p, rows) in net.tables.items()}})


def forward_sample(net: Network, spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n rows drawn along the edges, each variable by one expression over its parents' columns."""
    df = spark.range(n)
    done: set[str] = set()
    while len(done) < len(net.tables):
        ready = [v for v, (p, _) in net.tables.items() if v not in done and set(p) <= done]
        if not ready:
            raise ValueError("the network has a cycle")
        for v in ready:
            parents, rows = net.tables[v]
            df = df.withColumn("_u", (F.pmod(F.xxhash64("id", F.lit(f"{seed}:{v}")), F.lit(1 << 30)) / float(1 << 30)))
            value = F.lit(None).cast("string")
            for key, p in rows.items():
                pick, total = F.lit(net.states[v][-1]), sum(p)
                for s, upto in reversed(list(zip(net.states[v][:-1], _running(p), strict=False))):
                    pick = F.when(F.col("_u") < upto / total, s).otherwise(pick)
                match = F.lit(True)
                for c, k in zip(parents, key, strict=True):
                    match = match & (F.col(c) == k)
                value = F.when(match, pick).otherwise(value)
            df = df.withColumn(v, value).drop("_u")
            done.add(v)
    return df.select(*net.tables)


def _running(p: Sequence[float]) -> list[float]:
    out, total = [], 0.0
    for x in p:
        total += x
        out.append(total)
    return out

"""Facts of language servers and type checkers: run outside, read as JSON, given as tables."""

from __future__ import annotations

import json
import subprocess
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMETER = "struct<name:string,position:int,declared_type:string,is_optional:boolean,is_rest:boolean>"
SYMBOL = f"struct<qualified_name:string,kind:string,name:string,signature:string,return_type:string,declared_type:string,start_line:int,end_line:int,parameters:array<{PARAMETER}>>"
REFERENCE = "struct<from_symbol:string,to_symbol:string,edge_type:string,receiver_type:string,call_form:string,confidence:double,precision_level:int,reason:string,line:int>"
TYPE = "struct<owner_symbol:string,name:string,kind:string,declared_type:string,inferred_type:string>"
SCHEMA = f"struct<files:array<struct<path:string,symbols:array<{SYMBOL}>,references:array<{REFERENCE}>,types:array<{TYPE}>>>>"
#: confidence of references: calls and accesses, resolved and not
CONFIDENCE = {("CALLS", True): 0.94, ("CALLS", False): 0.70, ("ACCESSES", True): 0.88, ("ACCESSES", False): 0.60}


class SemanticAdapter(Protocol):
    """What makes facts about a repository; further ones are added to ``ADAPTERS`` by language."""

    name: str

    def analyze(self, root: str) -> str:
        """The facts as JSON text."""
        ...


class ProcessAdapter:
    """Facts that an external program prints, given the repository as its last argument."""

    def __init__(self, name: str, command: list[str], timeout: int = 600):
        self.name, self.command, self.timeout = name, command, timeout

    def analyze(self, root: str) -> str:
        done = subprocess.run([*self.command, root], capture_output=True, text=True, timeout=self.timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"{self.name} ended with {done.returncode}: {done.stderr[-500:]}")
        json.loads(done.stdout)
        return done.stdout


ADAPTERS: dict[str, SemanticAdapter] = {}


def facts(spark: SparkSession, text: str) -> DataFrame:
    """One row per file of the facts in ``text``; absent parts are empty, text that is no such JSON gives no rows."""
    return read_facts(spark.createDataFrame([(text,)], "value string"))


def read_facts(rows: DataFrame) -> DataFrame:
    """The same for a column ``value`` of JSON texts, one for each repository or file."""
    parsed = rows.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("v")).where("v.files is not null").select(F.inline("v.files"))
    return parsed.where("path is not null").select(
        "path", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("symbols", f"array<{SYMBOL}>"), ("references", f"array<{REFERENCE}>"), ("types", f"array<{TYPE}>"))]
    )


def symbols_of(told: DataFrame) -> DataFrame:
    rows = told.select("path", F.inline("symbols"))
    return rows.where("qualified_name is not null").select(F.col("qualified_name").alias("qname"), "kind", "name", "path", "signature", "return_type", "declared_type", "start_line", "end_line")


def parameters_of(told: DataFrame) -> DataFrame:
    """``owner_qname, position, name, declared_type, is_optional, is_rest, confidence``."""
    rows = told.select(F.inline("symbols")).select(F.col("qualified_name").alias("owner_qname"), F.posexplode(F.coalesce("parameters", F.array().cast(f"array<{PARAMETER}>"))).alias("place", "p"))
    return rows.select(
        "owner_qname", F.coalesce("p.position", "place").alias("position"), "p.name", F.coalesce("p.declared_type", F.lit("")).alias("declared_type"), F.coalesce("p.is_optional", F.lit(False)).alias("is_optional"),
        F.coalesce("p.is_rest", F.lit(False)).alias("is_rest"), F.lit(0.95).alias("confidence"),
    )


def edges_of(told: DataFrame) -> DataFrame:
    """``src, dst, edge_type, confidence, precision_level, reason, line``: references with the confidence of their kind
    where the program gives none."""
    rows = told.select(F.inline("references")).where("from_symbol is not null and edge_type is not null")
    own = F.lit(0.8)
    for (kind, resolved), c in CONFIDENCE.items():
        own = F.when((F.col("edge_type") == kind) & (F.col("to_symbol").isNotNull() == F.lit(resolved)), c).otherwise(own)
    return rows.select(
        F.col("from_symbol").alias("src"), F.col("to_symbol").alias("dst"), "edge_type", F.coalesce("confidence", own).alias("confidence"), F.coalesce("precision_level", F.lit(3)).alias("precision_level"),
        F.coalesce("reason", F.concat_ws(":", F.lit("semantic"), "call_form")).alias("reason"), "line",
    )


def types_of(told: DataFrame) -> DataFrame:
    """``owner_qname, name, kind, declared_type``: the declared type, else the inferred one."""
    rows = told.select(F.inline("types"))
    return rows.select(F.col("owner_symbol").alias("owner_qname"), "name", F.coalesce("kind", F.lit("variable")).alias("kind"), F.coalesce(F.nullif("declared_type", F.lit("")), "inferred_type").alias("declared_type"))

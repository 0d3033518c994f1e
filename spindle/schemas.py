"""Table contracts, and missing values brought to one form.

Tables have explicit schemas; nothing is inferred where a contract exists.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "benchmark": "item_id long, text string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def assert_contract(df: DataFrame, contract: T.StructType, mode: str = "warn") -> DataFrame:
    """A missing column always fails; another type fails with ``mode="raise"`` and else warns."""
    there = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in contract if f.name not in there]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for f in contract:
        if there[f.name] != f.dataType:
            said = f"{f.name} is {there[f.name].simpleString()}, not {f.dataType.simpleString()}"
            if mode == "raise":
                raise TypeError(said)
            warnings.warn(said, stacklevel=2)
    return df


def flat_metadata_errors(contract: T.StructType) -> list[str]:
    """Fields that aren't flat primitives, which metadata must be."""
    return [f.name for f in contract if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column, so that aggregates skip it."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])

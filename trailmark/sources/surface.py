"""Views and functions for users who write SQL: register() once per session, then spark.sql().

The views are temporary ones over DataFrames of the caller, checked for their columns; nothing is read or copied. The
functions are SQL functions with an expression as body, which Catalyst puts in place, so a query stays what it
would be with the Column functions of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.geo import EARTH_M, Cost
from ..functions.text import ACCENTED, LOCAL_HOST, PLAIN
from ..functions.time import DURATION

#: The columns that a view has at least.
VIEWS = {
    "triples": ("dump", "s", "p", "o", "o_kind", "o_dtype"),
    "media": ("m", "kind", "date_lex", "tours", "authors", "lists"),
    "tours": ("tour", "title", "energy", "series"),
    "fixes": ("trip", "seq", "t", "lat", "lng"),
    "cells": ("r", "c", "h", "mask"),
    "roads": ("edge", "a", "b", "cost_ab", "cost_ba"),
}

_KEY = f"lower(translate(coalesce(x, ''), '{ACCENTED}', '{PLAIN}'))"
_COST = Cost()
_PART = "coalesce(try_cast(nullif(regexp_extract(x, r'{}', 1), '') AS DOUBLE), 0.0)"
_SECONDS = f"{_PART.format('([0-9]+)D')} * 86400 + {_PART.format('([0-9]+)H')} * 3600 + {_PART.format('T(?:[0-9]+H)?([0-9]+)M')} * 60 + {_PART.format('([0-9]+(?:[.][0-9]+)?)S')}"
_HALF = "cast(conv(substring({}, {}, 8), 16, 10) AS BIGINT)"
_BITS = " + ".join(f"bit_count({_HALF.format('a', k)} ^ {_HALF.format('b', k)})" for k in (1, 9))

#: Signature, type and body of each function.
FUNCTIONS = {
    "norm_key": ("x STRING", "STRING", f"regexp_replace({_KEY}, '[^a-z0-9]+', '')"),
    "route_slug": ("x STRING", "STRING", f"btrim(substring(btrim(regexp_replace({_KEY}, '[^a-z0-9]+', '-'), '-'), 1, 60), '-')"),
    "iri_tail": ("x STRING", "STRING", "regexp_extract(x, '([^/#]*)$', 1)"),
    "stem_hash": ("x STRING", "STRING", "substring(md5(x), 1, 16)"),
    "is_hash16": ("x STRING", "BOOLEAN", "coalesce(x RLIKE '^[0-9a-f]{16}$', false)"),
    "valid_token": ("x STRING", "BOOLEAN", "coalesce(x RLIKE '^[0-9a-fA-F-]{1,64}$', false)"),
    "is_local_host": ("x STRING", "BOOLEAN", f"x RLIKE r'{LOCAL_HOST}'"),
    "hamming_hex": ("a STRING, b STRING", "INT", _BITS),
    "iso_duration_s": ("x STRING", "DOUBLE", f"CASE WHEN x RLIKE r'{DURATION}' THEN {_SECONDS} END"),
    "weekday_of": ("x STRING", "INT", "dayofweek(try_to_date(substring(x, 1, 10), 'yyyy-MM-dd')) - 1"),
    "tour_week": ("x TIMESTAMP", "DATE", "cast(date_trunc('week', x) AS DATE)"),
    "haversine_m": (
        "lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE",
        "DOUBLE",
        f"{2 * EARTH_M} * asin(sqrt(CASE WHEN pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2) > 1 THEN 1.0D ELSE pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2) END))",
    ),
    "leg_energy": (
        "d DOUBLE, dh DOUBLE",
        "DOUBLE",
        f"CASE WHEN dh >= 0 THEN {_COST.a_roll}D * d + CASE WHEN dh < {_COST.climb_thr}D * d THEN {_COST.a_aero}D * d ELSE 0.0D END + {_COST.beta}D * dh"
        f" ELSE greatest(({_COST.a_roll}D + {_COST.a_aero}D) * d - greatest(least(try_divide({_COST.ab_ratio}D * d, -dh), 1.0D) - {_COST.eps_offset}D, 0.0D) * {_COST.beta}D * -dh, 0.0D) END",
    ),
}


def register_functions(spark: SparkSession) -> None:
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """The functions, and a view for each table given under one of the names in VIEWS."""
    register_functions(spark)
    for name, df in tables.items():
        if name not in VIEWS:
            raise ValueError(f"no view of the name {name}; there are {', '.join(VIEWS)}")
        missing = [c for c in VIEWS[name] if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        df.createOrReplaceTempView(name)

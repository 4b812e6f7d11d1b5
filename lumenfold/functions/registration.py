"""Functions of this engine for use in SQL text."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Names and bodies of scalar functions; SQL bodies are inlined by the optimizer.
SCALARS = {
    "lf_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": (
        "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
    ),
    "lf_bits_apart(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "lf_file_name(path STRING) RETURNS STRING": "regexp_extract(path, '[^/]*$', 0)",
    "lf_place(q DOUBLE, n BIGINT) RETURNS BIGINT": "least(n - 1, cast(floor(n * q) AS BIGINT))",
}


@udtf(returnType="cue INT, start_s DOUBLE, end_s DOUBLE, body STRING")
class Cues:
    """The cues of a subtitle text, numbered from 1; blocks without a timing line are left out."""

    def eval(self, text: str):
        number = 0
        for block in re.split(r"\n\s*\n", (text or "").replace("\r\n", "\n").strip()):
            found = re.search(r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3}) --> (\d{2}):(\d{2}):(\d{2})[,.](\d{3})[^\n]*\n?(.*)", block, re.S)
            if found:
                number += 1
                h, m, s, ms, h2, m2, s2, ms2 = map(int, found.groups()[:8])
                yield number, h * 3600 + m * 60 + s + ms / 1000, h2 * 3600 + m2 * 60 + s2 + ms2 / 1000, found[9].strip()


def register(spark: SparkSession) -> None:
    """Registers the scalar functions, and lf_cues as a table function, for the session."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("lf_cues", Cues)

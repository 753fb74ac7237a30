"""Feature packets: JSON text, one frame or a batch of them, to frame rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed defaults of absent or malformed numbers.
DEFAULTS = {"face": 0.0, "lighting": 0.0, "sharpness": 0.0, "motion": 1.0, "skin_fraction": 0.0, "compression": 1.0}


def _number(path: str):
    return F.get_json_object("packet", f"$.{path}").try_cast("double")


def parse(messages: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per frame of a message: ``i`` in message order, r, g, b, valid and quality.

    Missing or bad numbers take their defaults. rgb must be three numbers, else
    the frame is invalid. An empty batch holds no frame, and a closing or
    unreadable message is dropped.
    """
    batch = F.from_json(F.get_json_object(json_col, "$.frames"), "array<string>")
    one = F.when(F.get_json_object(json_col, "$.close").isNull() & F.try_parse_json(json_col).isNotNull(), F.array(F.col(json_col)))
    rows = messages.withColumn("__all", F.coalesce(batch, one)).select("*", F.posexplode("__all").alias("at", "packet")).drop("__all")
    rgb = [_number(f"rgb[{k}]") for k in range(3)]
    whole = _number("rgb[3]").isNull() & F.get_json_object("packet", "$.rgb[3]").isNull()
    for x in rgb:
        whole = whole & x.isNotNull()
    said = F.coalesce(F.get_json_object("packet", "$.valid").try_cast("boolean"), F.lit(False))
    cols = {c: F.coalesce(_number(c), F.lit(d)) for c, d in DEFAULTS.items()}
    out = rows.withColumns({"r": rgb[0], "g": rgb[1], "b": rgb[2], "__ok": whole, "valid": said} | cols)
    out = out.withColumn("valid", F.col("valid") & F.col("__ok"))
    return out.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in "rgb"}).drop("packet", "__ok")

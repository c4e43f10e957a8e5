"""From landed JSON payloads of parallel arrays to rows, with bad payloads set aside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.sources.feeds import Feed


def parse_payload(df: DataFrame, feed: Feed, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Rows and errors of a frame with a payload text; its other columns are kept.

    Arrays are zipped by the time array: longer ones are cut, a shorter or missing one rejects the
    payload, as do text that is not the feed's JSON and a time that cannot be read. An empty time
    array gives no rows and no error. JSON nulls stay null. Rows have payload_pos, their place.
    """
    keys = [c for c in df.columns if c != payload]
    parsed = df.withColumn("_p", F.from_json(payload, feed.payload_schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    root = F.col("_p")[feed.root]
    time = root["time"]
    stamp = (lambda t: F.try_to_timestamp(F.concat(t, F.lit(":00")), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")) if feed.root == "hourly" else (lambda t: F.try_to_date(t, "yyyy-MM-dd"))
    short = reduce(lambda a, b: a | b, (F.coalesce(F.size(root[p]) < F.size(time), F.lit(True)) | root[p].isNull() for p, _, _ in feed.measures))
    reason = (
        F.when(F.col(payload).isNull() | F.col("_p").isNull() | F.col("_p")["_corrupt"].isNotNull(), "corrupt_json")
        .when(time.isNull(), "missing_time")
        .when(short, "short_array")
        .when(F.exists(time, lambda t: stamp(t).isNull()), "bad_time")
    )
    parsed = parsed.withColumn("reason", reason)
    errors = parsed.where("reason is not null").select(*keys, F.lit(feed.name).alias("feed"), "reason")
    zipped = F.arrays_zip(time.alias("t"), *(F.slice(root[p], F.lit(1), F.size(time)).alias(c) for p, c, _ in feed.measures))
    rows = parsed.where("reason is null").select(*keys, F.posexplode(zipped).alias("payload_pos", "_r"))
    names = ["t", *(c for _, c, _ in feed.measures)]
    fields = [f.name for f in rows.schema["_r"].dataType.fields]
    value = dict(zip(names, (F.col("_r")[f] for f in fields), strict=True))
    return rows.select(
        *keys,
        stamp(value["t"]).alias(feed.time_column),
        *(F.lit(v).alias(c) for c, v in feed.constants.items()),
        *(value[c].alias(c) for _, c, _ in feed.measures),
        "payload_pos",
    ), errors

"""Driver tables as tables of pixels (slide_id, t, label, x, y, z, inten), as SQL over the tables' views.

dense: each embedding is an 8x8 image, quartered into four regions or taken whole; sparse: line items scattered over a small
grid, one region for each line number; temporal: events by day, hour and five minutes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUARTERS = "1 + cast(floor(x / 4e0) as bigint) + 2 * cast(floor(y / 4e0) as bigint)"


def dense_sql(dialect: str, table: str = "embeddings", quarters: bool = False) -> str:
    cells = f"SELECT vec_id, cast(v as double) AS v, cast(pos as bigint) AS pos FROM {table} LATERAL VIEW posexplode(embedding) e AS pos, v" if dialect == "spark" else f"SELECT vec_id, cast(unnest(embedding) as double) AS v, cast(generate_subscripts(embedding, 1) - 1 as bigint) AS pos FROM {table}"
    placed = f"SELECT vec_id, v, pos % 8 AS x, cast(floor(pos / 8e0) as bigint) AS y FROM ({cells}) AS c"
    return f"SELECT cast(vec_id as string) AS slide_id, cast(0 as bigint) AS t, cast({_QUARTERS if quarters else '1'} as bigint) AS label, x, y, cast(0 as bigint) AS z, cast(greatest(least(floor(v * 128e0) + 128e0, 255e0), 1e0) as bigint) AS inten FROM ({placed}) AS p"


def sparse_sql(dialect: str, table: str = "lineitem", side: int = 32) -> str:
    return f"SELECT cast(l_suppkey as string) AS slide_id, cast(0 as bigint) AS t, cast(l_linenumber as bigint) AS label, l_partkey % {side} AS x, l_orderkey % {side} AS y, cast(0 as bigint) AS z, cast(max(l_quantity) as bigint) AS inten FROM {table} GROUP BY l_suppkey, l_linenumber, l_partkey % {side}, l_orderkey % {side}"


def temporal_sql(dialect: str, table: str = "events", three_d: bool = False, side: int = 8) -> str:
    """Events of a type and day, users in 16 regions; as volumes z is the day."""
    day = "cast(day(ts) as bigint)"
    user = "cast(user_id % 4 as bigint)" if three_d else "cast(user_id % 16 as bigint)"
    x, y = (f"cast(hour(ts) as bigint) % {side}", f"cast(floor(minute(ts) / 5e0) as bigint) % {side}") if three_d else ("cast(hour(ts) as bigint)", "cast(floor(minute(ts) / 5e0) as bigint)")
    t, z = ("cast(0 as bigint)", day) if three_d else (day, "cast(0 as bigint)")
    return f"SELECT slide_id, t, label, x, y, z, cast(max(v) as bigint) AS inten FROM (SELECT event_type AS slide_id, {t} AS t, {user} AS label, {x} AS x, {y} AS y, {z} AS z, floor(value) AS v FROM {table}) AS e GROUP BY slide_id, t, label, x, y, z"


ADAPTERS = {
    "dense": lambda d: dense_sql(d),
    "quarters": lambda d: dense_sql(d, quarters=True),
    "sparse": lambda d: sparse_sql(d),
    "compact": lambda d: sparse_sql(d, side=12),
    "temporal": lambda d: temporal_sql(d),
    "volume": lambda d: temporal_sql(d, three_d=True),
}
_TABLE = {"dense": "embeddings", "quarters": "embeddings", "sparse": "lineitem", "compact": "lineitem", "temporal": "events", "volume": "events"}
_SIDE = {"sparse": 32, "compact": 12}
#: The most pixels that a region of an adapter can have, however large the table.
BOUNDED = {"dense": 64, "quarters": 16, **{k: side * side for k, side in _SIDE.items()}}


#: Rows of a task: what it holds at once follows from this number, not from the size of the table.
TASK_ROWS = 1 << 16


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """df partitioned by keys, into a number of partitions that grows with its number of rows."""
    few = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 4096))
    return df.repartition(max(1, few, -(-rows // TASK_ROWS)), *keys)


def by_region(spark: SparkSession, sf_dir: str, adapter: str, slides: bool = False) -> DataFrame:
    """Pixels of an adapter whose regions a grid bounds (at most 1024 pixels), each region, or each slide, whole in a partition.

    Rows move once, before they become pixels; what is grouped, joined or ordered by region (by slide) moves none again.
    """
    table = spark.read.parquet(f"{sf_dir}/{_TABLE[adapter]}.parquet")
    if _TABLE[adapter] == "embeddings":
        whole = dealt(table.select(F.col("vec_id").cast("string").alias("slide_id"), "embedding"), ["slide_id"], 64 * table.count())
        text = ADAPTERS[adapter]("spark").replace("vec_id", "slide_id").replace("FROM embeddings", "FROM {table}")
        return spark.sql(text, table=whole)
    side = _SIDE[adapter]
    cells = table.selectExpr("cast(l_suppkey as string) AS slide_id", "cast(l_linenumber as bigint) AS label", f"l_partkey % {side} AS x", f"l_orderkey % {side} AS y", "l_quantity")
    return spark.sql("SELECT slide_id, cast(0 as bigint) AS t, label, x, y, cast(0 as bigint) AS z, cast(max(l_quantity) as bigint) AS inten FROM {table} GROUP BY slide_id, label, x, y", table=dealt(cells, ["slide_id"] if slides else ["slide_id", "label"], table.count()))


def pixels(spark: SparkSession, sf_dir: str, adapter: str, slides: bool = False) -> DataFrame:
    """An adapter's pixels, read from the driver's folder. slides: regions of a slide meet, so they are dealt together."""
    if adapter in BOUNDED:
        return by_region(spark, sf_dir, adapter, slides)
    table = _TABLE[adapter]
    text = ADAPTERS[adapter]("spark").replace(f"FROM {table}", "FROM {table}")
    return spark.sql(text, table=spark.read.parquet(f"{sf_dir}/{table}.parquet"))

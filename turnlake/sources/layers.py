"""Writing a layer: staging as views, marts as tables, intermediates not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from turnlake.sources.folders import names_in, remove
from turnlake.sources.snapshots import live_folders


def as_view(
    spark: SparkSession, schema: str, name: str, columns: list[str], path: str
) -> DataFrame:
    """Define ``schema.name`` as those columns of the log at ``path``, or of its Parquet files.

    The view shows the log as it is now. It is readable until the log has changed twice.
    """
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    folders = live_folders(spark, path) or [path]
    parts = [f"SELECT {', '.join(columns)} FROM parquet.`{folder}`" for folder in folders]
    spark.sql(f"CREATE OR REPLACE VIEW {schema}.{name} AS {' UNION ALL '.join(parts)}")
    return spark.table(f"{schema}.{name}")


def as_table(df: DataFrame, schema: str, name: str, root: str | None = None) -> DataFrame:
    """Rebuild ``schema.name`` and return it as read back from storage.

    The files lie in a folder of this build below ``root/schema/name``, by default below the
    warehouse. Once they are complete, one catalog call moves the table to them, so a build that
    fails leaves the old table and readers find one at any time; the folders of earlier builds go
    after that. If the columns have changed, the new table is made under a name of its own, and
    takes the old one's place when that has worked.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tables"
    top, build = f"{root}/{schema}/{name}", uuid.uuid4().hex
    earlier = names_in(spark, top)
    df.write.parquet(f"{top}/{build}")
    place = f"{top}/{build}".replace("'", "\\'")
    table = f"{schema}.{name}"

    def create(called: str) -> None:
        columns = df._jdf.schema().toDDL()  # quotes any column name
        spark.sql(f"CREATE TABLE {called} ({columns}) USING parquet LOCATION '{place}'")

    if not spark.catalog.tableExists(table):
        create(table)
    elif _columns(spark.table(table)) == _columns(df):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
        spark.catalog.refreshTable(table)
    else:
        create(f"{table}__{build}")
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"ALTER TABLE {table}__{build} RENAME TO {table}")
    for old in earlier:
        remove(spark, f"{top}/{old}")
    return spark.table(table)


def _columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def drop_tables(spark: SparkSession, schema: str, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {schema}.{name}")

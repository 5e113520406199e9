"""A fluent frame: the library's operators as methods that return frames.

    Frame(df).filter(F.col("v") > 1).group_by("k").sum("v").sort("k").collect()

Nothing runs before collect, count, write or an operator whose schema depends on the data.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from sparkloom.functions import strings
from sparkloom.operators import agg, joins, missing, resample, reshape, rows, stats, window
from sparkloom.sources import files

#: Method: function that takes the DataFrame first.
METHODS: dict[str, Callable[..., Any]] = {
    "select": rows.select, "drop": rows.drop, "rename": rows.rename, "filter": rows.filter_rows, "with_column": rows.with_column, "with_columns": rows.with_columns, "with_columns_ordered": rows.with_columns_ordered,
    "sort": rows.sort, "arg_sort": rows.arg_sort, "head": rows.head, "tail": rows.tail, "slice": rows.slice_rows, "take": rows.take, "row": rows.get_row, "with_row_index": rows.with_row_index, "with_columns_frame": rows.hstack,
    "add_column": rows.add_column, "column": rows.column, "column_at": rows.column_at, "clone": rows.clone, "to_text": rows.to_text, "concat_columns": lambda df, other, order_bys: reshape.concat_columns([df, other], order_bys),
    "union_distinct": reshape.union_distinct, "intersect": reshape.intersect, "subtract": reshape.subtract, "to_integer": strings.to_integer_column,
    "shape": rows.shape, "is_empty": rows.is_empty, "has_column": rows.has_column,
    "join": joins.join, "join_where": joins.join_where, "merge_asof": joins.asof_join, "rolling_join": joins.rolling_join,
    "top_k": agg.group_top_k, "reduce": agg.reduce_columns, "over": window.over, "over_all": window.over_all,
    "pivot": reshape.pivot, "melt": reshape.melt, "unpivot": reshape.unpivot, "stack": reshape.stack, "unstack": reshape.unstack, "transpose": reshape.transpose, "explode": reshape.explode,
    "drop_null": missing.drop_null, "drop_duplicates": missing.drop_duplicates, "fill_null": missing.fill_null, "forward_fill": missing.forward_fill, "backward_fill": missing.backward_fill, "interpolate": missing.interpolate,
    "cum_sum": missing.cum_sum, "cum_prod": missing.cum_prod, "cum_max": missing.cum_max, "cum_min": missing.cum_min, "cum_count": missing.cum_count,
    "quantile": stats.quantile, "percentile": stats.percentile, "correlation": stats.correlation, "covariance": stats.covariance, "mode": stats.mode, "skew": stats.skew, "kurtosis": stats.kurtosis,
    "value_counts": stats.value_counts, "n_unique": stats.n_unique, "rank": stats.rank, "describe": stats.describe, "resample": resample.resample,
    "write_csv": files.write_csv, "write_parquet": files.write_parquet, "write_json": files.write_json, "write_ndjson": files.write_ndjson,
}


def _plain(x: Any) -> Any:
    return x.df if isinstance(x, Frame) else x


class Grouped:
    def __init__(self, grouped: agg.GroupBy):
        self._grouped = grouped

    def __getattr__(self, name: str) -> Callable[..., Frame]:
        method = getattr(self._grouped, name)
        return lambda *a, **k: Frame(method(*a, **k))


class Frame:
    """Wraps a DataFrame, which is its `df`."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __getattr__(self, name: str) -> Callable[..., Any]:
        if name not in METHODS:
            raise AttributeError(name)

        def call(*args: Any, **options: Any) -> Any:
            out = METHODS[name](self.df, *[_plain(a) for a in args], **{k: _plain(v) for k, v in options.items()})
            return Frame(out) if isinstance(out, DataFrame) else out

        return call

    def group_by(self, *keys: str) -> Grouped:
        return Grouped(agg.GroupBy(self.df, *keys))

    def aggregate(self, **named: Column) -> Frame:
        return Frame(self.df.agg(*[c.alias(n) for n, c in named.items()]))

    def __str__(self) -> str:
        return rows.to_text(self.df)

    def collect(self) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def explain(self, mode: str = "formatted") -> str:
        """The plan that Spark has chosen, as text."""
        explained = self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
        return self.df._jdf.queryExecution().explainString(explained)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self):
        return self.df.schema


def scan_csv(spark: SparkSession, path: str, **options: Any) -> Frame:
    return Frame(files.read_csv(spark, path, **options))


def scan_parquet(spark: SparkSession, path: str, **options: Any) -> Frame:
    return Frame(files.read_parquet(spark, path, **options))


def concat(frames: list[Frame], **options: Any) -> Frame:
    return Frame(reshape.concat([f.df for f in frames], **options))

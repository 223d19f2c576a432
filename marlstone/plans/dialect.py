"""One text of a relational query for two engines.

A query is written once as SQL over the canonical relations, with the few spellings
that differ left to a dialect. Spark runs it over the adapters' DataFrames, so that
Catalyst plans it like any other; DuckDB runs it over the same views as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources import adapters

VIEWS = {
    "quotes": (adapters.quotes, adapters.QUOTES),
    "every_quote": (adapters.every_quote, adapters.EVERY_QUOTE),
    "news": (adapters.news, adapters.NEWS),
    "usage": (adapters.usage, adapters.USAGE),
    "trades": (adapters.trades, adapters.TRADES),
    "closed_trades": (adapters.closed_trades, adapters.CLOSED_TRADES),
    "runs": (adapters.runs, adapters.RUNS),
    "vectors": (adapters.vectors, adapters.VECTORS),
}


class SparkSql:
    """Spark's spellings."""

    @staticmethod
    def lit(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rx(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)})"

    def one(self, x: str, pattern: str) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, 1)"

    def every(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def unnest(self, x: str) -> str:
        return f"explode({x})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def has(self, x: str, item: str) -> str:
        return f"array_contains({x}, {item})"

    def distinct(self, x: str) -> str:
        return f"array_sort(array_distinct({x}))"

    def filter(self, x: str, var: str, cond: str) -> str:
        return f"filter({x}, {var} -> {cond})"

    def join(self, x: str, glue: str) -> str:
        return f"array_join({x}, {self.lit(glue)})"

    def gather(self, x: str, order: str) -> str:
        """Text of ``x``, joined by commas in the order of the single key ``order``."""
        return f"array_join(transform(array_sort(collect_list(struct({order} AS k, CAST({x} AS STRING) AS v))), y -> y.v), ',')"

    def seconds(self, x: str) -> str:
        return f"unix_timestamp({x})"

    def day(self, seconds: str) -> str:
        return f"CAST(timestamp_seconds({seconds}) AS DATE)"

    def days(self, first: str, last: str) -> str:
        """A row for each day from ``first`` to ``last``."""
        return f"explode(sequence({first}, {last}, INTERVAL 1 DAY))"

    def even(self, x: str) -> str:
        """Rounded to a whole number, halves to the even one."""
        return f"bround({x}, 0)"

    def bits(self, x: str) -> str:
        return f"bit_count({x})"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"

    def shingles(self, x: str, n: int) -> str:
        return f"array_distinct(transform(sequence(1, greatest(length({x}) - {n - 1}, 1)), i -> substring({x}, i, {n})))"

    def common(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def missing(self, a: str, b: str) -> str:
        return f"size(array_except({a}, {b}))"

    def xor(self, a: str, b: str) -> str:
        return f"({a} ^ {b})"

    def vote(self, x: str, start: int) -> str:
        """32 bits by the votes of the tokens ``x``, whose own bits are eight hexadecimal digits of their digests from ``start`` on."""
        bits = f"transform({x}, t -> CAST(conv(substring(md5(t), {start}, 8), 16, 10) AS BIGINT))"
        sums = f"aggregate({bits}, array_repeat(0, 32), (s, y) -> transform(s, (v, j) -> v + CASE WHEN y & shiftleft(1L, j) != 0 THEN 1 ELSE -1 END))"
        return f"aggregate(transform({sums}, (v, j) -> CASE WHEN v > 0 THEN shiftleft(1L, j) ELSE 0L END), 0L, (s, y) -> s + y)"

    def is_json(self, x: str) -> str:
        return f"try_parse_json({x}) IS NOT NULL"

    def field(self, x: str, name: str) -> str:
        """Text of a field of a JSON object; null where it is missing or empty."""
        return f"nullif(get_json_object({x}, '$.{name}'), '')"

    def any_in(self, x: str, words: list[str]) -> str:
        """Whether one of ``words`` is in ``x``."""
        return f"exists(array({', '.join(map(self.lit, words))}), w -> contains({x}, w))"

    real, string, ref = "DOUBLE", "STRING", "$1"


class DuckSql(SparkSql):
    """DuckDB's."""

    @staticmethod
    def lit(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def rx(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def every(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def unnest(self, x: str) -> str:
        return f"unnest({x})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def has(self, x: str, item: str) -> str:
        return f"list_contains({x}, {item})"

    def distinct(self, x: str) -> str:
        return f"list_sort(list_distinct({x}))"

    def filter(self, x: str, var: str, cond: str) -> str:
        return f"list_filter({x}, lambda {var}: {cond})"

    def join(self, x: str, glue: str) -> str:
        return f"array_to_string({x}, {self.lit(glue)})"

    def gather(self, x: str, order: str) -> str:
        return f"string_agg(CAST({x} AS VARCHAR), ',' ORDER BY {order})"

    def seconds(self, x: str) -> str:
        return f"CAST(epoch({x}) AS BIGINT)"

    def day(self, seconds: str) -> str:
        return f"CAST(make_timestamp(({seconds}) * 1000000) AS DATE)"

    def days(self, first: str, last: str) -> str:
        return f"CAST(unnest(generate_series({first}, {last}, INTERVAL 1 DAY)) AS DATE)"

    def even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def dot(self, a: str, b: str) -> str:
        return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)), lambda s, x: s + x, 0e0)"

    def shingles(self, x: str, n: int) -> str:
        return f"list_distinct(list_transform(range(1, greatest(length({x}) - {n - 1}, 1) + 1), lambda i: substring({x}, i, {n})))"

    def common(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def missing(self, a: str, b: str) -> str:
        return f"len(list_filter({a}, lambda z: NOT list_contains({b}, z)))"

    def xor(self, a: str, b: str) -> str:
        return f"xor({a}, {b})"

    def vote(self, x: str, start: int) -> str:
        bits = f"list_transform({x}, lambda t: CAST('0x' || substr(md5(t), {start}, 8) AS BIGINT))"
        return f"CAST(list_sum(list_transform(range(32), lambda j: CASE WHEN list_sum(list_transform({bits}, lambda y: CASE WHEN (y & (CAST(1 AS BIGINT) << CAST(j AS BIGINT))) != 0 THEN 1 ELSE -1 END)) > 0 THEN CAST(1 AS BIGINT) << CAST(j AS BIGINT) ELSE 0 END)) AS BIGINT)"

    def field(self, x: str, name: str) -> str:
        return f"nullif(json_extract_string({x}, '$.{name}'), '')"

    def is_json(self, x: str) -> str:
        """It lets commas before a closing bracket pass, which are no JSON."""
        return f"json_valid({x}) AND NOT regexp_matches({x}, ',\\s*[}}\\]]')"

    def any_in(self, x: str, words: list[str]) -> str:
        return f"(len(list_filter([{', '.join(map(self.lit, words))}], lambda w: contains({x}, w))) > 0)"

    string, ref = "VARCHAR", "\\1"


Text = Callable[[SparkSql], str]


def run_text(spark: SparkSession, text: Text, **frames: DataFrame) -> DataFrame:
    """Runs ``text`` over relations given as DataFrames, so no view is registered."""
    sql = text(SparkSql()).replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(frames)})\b", r"\1 {\2}", sql), **frames)


def spark_query(text: Text, *views: str) -> Callable[[SparkSession, str], DataFrame]:
    """Runs ``text`` over the adapters' relations."""
    return lambda spark, sf_dir: run_text(spark, text, **{v: VIEWS[v][0](spark, sf_dir) for v in views})


def duck_query(text: Text, *views: str) -> str:
    sql = text(DuckSql()).strip()
    found = adapters.with_views(*(VIEWS[v][1] for v in views), sql=", " + re.sub(r"^WITH( RECURSIVE)?\s", "", sql) if sql.startswith("WITH") else " " + sql)
    return found.replace("WITH ", "WITH RECURSIVE ", 1) if sql.startswith("WITH RECURSIVE") else found


def both(found: dict[str, tuple]) -> tuple[dict, dict]:
    """(queries, oracles) of a table of name -> (text, relation, ...)."""
    return {n: spark_query(*x) for n, x in found.items()}, {n: duck_query(*x) for n, x in found.items()}

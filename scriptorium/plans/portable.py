"""Statements that run on Spark and, rendered in another dialect, on DuckDB.

An operator of the engine is a statement over named relations. ``run`` binds the
relations to DataFrames and leaves the physical plan to Catalyst; ``render`` gives the
same statement for DuckDB, which the correctness check runs beside it. Draws use
md5 uniforms, so they depend on the keys only, not on partitions or engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Spark:
    """Spelling of the few functions in which the two dialects differ."""

    name = "spark"

    def t(self, table: str) -> str:
        return "{" + table + "}"

    def match(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE '{pattern}')"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}')"

    def times(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, '{pattern}') AS BIGINT)"

    def each(self, i: str, lo: str, hi: str) -> str:
        """One row per integer in lo..hi; the caller also filters i <= hi, for empty ranges."""
        return f" LATERAL VIEW explode(sequence(CAST({lo} AS BIGINT), greatest(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT)))) AS {i}"

    def parts(self, x: str, by: str, pos: str, val: str) -> str:
        return f" LATERAL VIEW posexplode(split({x}, '{by}')) AS {pos}, {val}"

    def found(self, x: str, pattern: str, pos: str, val: str) -> str:
        return f" LATERAL VIEW posexplode(regexp_extract_all({x}, '{pattern}', 0)) AS {pos}, {val}"

    def grams(self, x: str, k: int, pos: str, gram: str) -> str:
        """One row per run of k characters, overlapping; by a look-ahead, since substr from the start would be quadratic."""
        return f" LATERAL VIEW posexplode(regexp_extract_all({x}, '(?=({'.' * k}))', 1)) AS {pos}, {gram}"

    def glue(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def quantile(self, x: str, q: str) -> str:
        return f"percentile({x}, {q})"

    def u(self, *keys: str) -> str:
        return f"(CAST(conv(substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8), 16, 10) AS DOUBLE) / 4294967296e0)"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def first_by(self, x: str, order: str) -> str:
        return f"min_by({x}, struct({order}))"

    def extract(self, x: str, pattern: str) -> str:
        """The first group of the pattern."""
        return f"regexp_extract({x}, '{pattern}', 1)"

    def lgamma(self, x: str) -> str:
        """Stirling's series at x + 8, brought back by the recurrence."""
        y, product = f"({x} + 8)", " * ".join(f"({x} + {k})" for k in range(8))
        return f"(({y} - 0.5e0) * ln({y}) - {y} + 0.9189385332046727e0 + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - ln({product}))"

    def listed(self, x: str, order: str) -> str:
        return f"concat_ws(',', transform(array_sort(collect_list(struct({order}, {x} AS v))), s -> CAST(s.v AS STRING)))"


class Duck(Spark):
    name = "duck"

    def t(self, table: str) -> str:
        return table

    def match(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def times(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"

    def each(self, i: str, lo: str, hi: str) -> str:
        return f", LATERAL (SELECT unnest(generate_series(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))) AS {i})"

    def parts(self, x: str, by: str, pos: str, val: str) -> str:
        by = {"\\n": "chr(10)"}.get(by, f"'{by}'")
        return f", LATERAL (SELECT unnest(string_split({x}, {by})) AS {val}, CAST(generate_subscripts(string_split({x}, {by}), 1) - 1 AS INTEGER) AS {pos})"

    def found(self, x: str, pattern: str, pos: str, val: str) -> str:
        return f", LATERAL (SELECT unnest(regexp_extract_all({x}, '{pattern}')) AS {val}, CAST(generate_subscripts(regexp_extract_all({x}, '{pattern}'), 1) - 1 AS INTEGER) AS {pos})"

    def grams(self, x: str, k: int, pos: str, gram: str) -> str:
        return f", LATERAL (SELECT substr({x}, j, {k}) AS {gram}, CAST(j - 1 AS INTEGER) AS {pos} FROM (SELECT unnest(generate_series(1, length({x}) - {k - 1})) AS j) gs)"

    def glue(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def quantile(self, x: str, q: str) -> str:
        return f"quantile_cont({x}, {q})"

    def u(self, *keys: str) -> str:
        return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::BIGINT AS DOUBLE) / 4294967296e0)"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def first_by(self, x: str, order: str) -> str:
        return f"arg_min({x}, row({order}))"

    def lgamma(self, x: str) -> str:
        return f"lgamma({x})"

    def listed(self, x: str, order: str) -> str:
        return f"string_agg(CAST({x} AS VARCHAR), ',' ORDER BY {order})"


SPARK, DUCK = Spark(), Duck()
Statement = Callable[[Spark], str]
TABLES = ("documents", "doc_records", "split_members", "run_configs", "folio_pages", "folio_tokens", "score_cells", "forename_forms")


def with_relations(d: Spark, relations: dict[str, Statement], body: str) -> str:
    """``body`` behind the shared relations it names (and those they name in turn)."""
    import re

    needed: list[str] = []

    def need(text: str) -> None:
        for name in relations:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(relations[name](d))
                if name not in needed:
                    needed.append(name)

    need(body)
    shared = ", ".join(f"{n} AS ({relations[n](d)})" for n in needed)
    if not shared:
        return body
    return f"WITH {shared}, {body[5:]}" if body.startswith("WITH ") else f"WITH {shared} {body}"


def run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The statement over DataFrames bound to the relation names in braces."""
    used = {k: v for k, v in tables.items() if "{" + k + "}" in sql}
    return spark.sql(sql, **used)


def wilson(k: str, n: str, sign: str) -> str:
    """Bound of the 95 % Wilson interval as an expression; null where n is 0."""
    p = f"({k} / nullif({n}, 0))"
    return f"(({p} + 3.8416e0 / (2 * {n}) {sign} 1.96e0 * sqrt({p} * (1 - {p}) / {n} + 3.8416e0 / (4e0 * {n} * {n}))) / (1 + 3.8416e0 / {n}))"


def entropy(n: str, total: str) -> str:
    """Summand of the base-2 entropy."""
    return f"-({n} / {total}) * log2({n} / {total})"

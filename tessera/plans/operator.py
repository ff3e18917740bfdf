"""Relational operators as named plans over alignment views.

A view or operator is written once as a SQL text over other views and rendered for a dialect.  On Spark
the leaves are DataFrames: the driver's tables, or the caller's own in place of any view, so that
``OPERATORS["pair_distance"].run(spark, sites=my_sites)`` works on any alignment.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_dir

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class SparkDialect:
    name = "spark"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def xor(self, a: str, b: str) -> str:
        return f"({a} ^ {b})"

    def shr(self, a: str, n: int) -> str:
        return f"shiftright({a}, {n})"

    def bits(self, a: str) -> str:
        return f"bit_count({a})"

    def each(self, first: str, last: str) -> str:
        return f"explode(sequence({first}, {last}))"

    def at(self, array: str, i: str) -> str:
        return f"element_at({array}, {i})"

    def days(self, since: str, to: str) -> str:
        return f"datediff({to}, DATE'{since}')"

    def joined(self, value: str, order: str, sep: str = "") -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order} AS k, {value} AS v))), x -> x.v), '{sep}')"

    def matches(self, text: str, pattern: str) -> str:
        return f"({text} RLIKE '{pattern}')"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by.replace(chr(92) + '1', '$1')}')"

    def round_even(self, x: str) -> str:
        return f"CAST(bround({x}, 0) AS BIGINT)"

    def piece(self, text: str, sep: str, k: str) -> str:
        return f"split_part({text}, '{sep}', {k})"


class DuckDialect(SparkDialect):
    name = "duckdb"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def xor(self, a: str, b: str) -> str:
        return f"xor({a}, {b})"

    def shr(self, a: str, n: int) -> str:
        return f"({a} >> {n})"

    def bits(self, a: str) -> str:
        return f"CAST(bit_count({a}) AS INTEGER)"

    def each(self, first: str, last: str) -> str:
        return f"unnest(range({first}, {last} + 1))"

    def at(self, array: str, i: str) -> str:
        return f"{array}[{i}]"

    def days(self, since: str, to: str) -> str:
        return f"datediff('day', DATE '{since}', CAST({to} AS DATE))"

    def joined(self, value: str, order: str, sep: str = "") -> str:
        return f"string_agg({value}, '{sep}' ORDER BY {order})"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    def round_even(self, x: str) -> str:
        return f"CAST(round_even({x}, 0) AS BIGINT)"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


SPARK, DUCK = SparkDialect(), DuckDialect()
Text = Callable[[SparkDialect], str]


@dataclass(frozen=True)
class View:
    needs: tuple[str, ...]
    text: Text


VIEWS: dict[str, View] = {}
#: Views that Spark builds from the DataFrames of what they need, as their SQL is recursive.
BUILT: dict[str, Callable[..., DataFrame]] = {}
#: Operators that Spark builds from the DataFrames of some views, as their SQL makes a row of every pair.
SHORTENED: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}
OPERATORS: dict[str, Operator] = {}


def view(name: str, *needs: str) -> Callable[[Text], Text]:
    def keep(text: Text) -> Text:
        VIEWS[name] = View(needs, text)
        return text

    return keep


def built(name: str, *needs: str, sql: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """A view made by a function of DataFrames on Spark, and by recursive SQL on DuckDB."""

    def keep(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        VIEWS[name] = View(needs, lambda _: sql)
        BUILT[name] = build
        return build

    return keep


def shortened(name: str, *needs: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """What Spark builds in place of the SQL of a view or an operator, unless the caller gives what that SQL is over."""

    def keep(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in VIEWS:
            BUILT[name] = build
        else:
            SHORTENED[name] = needs, build
        return build

    return keep


def selected(name: str, spark: SparkSession, **frames: DataFrame) -> DataFrame:
    """The rows of a view."""
    return Operator(name, (name,), lambda _: f"SELECT * FROM {name}", "").run(spark, **frames)


def stored(name: str, *needs: str) -> Callable[[Text], Text]:
    """A view that Spark works out once and writes to the session's folder for checkpoints, as much stands on it."""

    def keep(text: Text) -> Text:
        VIEWS[name] = View(needs, text)

        def build(*frames: DataFrame) -> DataFrame:
            spark = frames[0].sparkSession
            shared_dir(spark)
            return Operator(name, needs, text, "").run(spark, **dict(zip(needs, frames, strict=True))).checkpoint()

        BUILT[name] = build
        return text

    return keep


@dataclass(frozen=True)
class Operator:
    name: str
    needs: tuple[str, ...]
    text: Text
    doc: str

    def _parts(self, leaves: set[str]) -> tuple[list[str], list[str]]:
        """Leaves used, and views in the order in which each follows what it needs."""
        used, order = [], []

        def visit(name: str) -> None:
            if name in leaves:
                if name not in used:
                    used.append(name)
            elif name not in order:
                for n in VIEWS[name].needs:
                    visit(n)
                order.append(name)

        for n in self.needs:
            visit(n)
        return used, order

    def duckdb(self) -> str:
        _, order = self._parts(set(TABLES))
        ctes = ",\n".join(f"{v} AS ({VIEWS[v].text(DUCK)})" for v in order)
        return (f"WITH {ctes}\n" if ctes else "") + self.text(DUCK)

    def run(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        if OPERATORS.get(self.name) is self and self.name in SHORTENED and not set(self.needs) & set(frames):
            needs, build = SHORTENED[self.name]
            return build(*(selected(n, spark, **frames) for n in needs))
        for name in [v for v in self._parts(set(frames))[1] if v in BUILT]:
            frames[name] = BUILT[name](*(selected(n, spark, **frames) for n in VIEWS[name].needs))
        used, order = self._parts(set(frames))
        ctes = [f"{u} AS (SELECT * FROM {{{u}}})" for u in used] + [f"{v} AS ({VIEWS[v].text(SPARK)})" for v in order]
        return spark.sql("WITH " + ",\n".join(ctes) + "\n" + self.text(SPARK), **{u: frames[u] for u in used})

    def query(self) -> Callable[[SparkSession, str], DataFrame]:
        used, _ = self._parts(set(TABLES))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return self.run(spark, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

        run.__name__, run.__doc__ = self.name, self.doc
        return run


def operator(name: str, *needs: str) -> Callable[[Text], Text]:
    def keep(text: Text) -> Text:
        OPERATORS[name] = Operator(name, needs, text, (text.__doc__ or "").strip())
        return text

    return keep

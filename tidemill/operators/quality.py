"""Data-quality checks: typed specs, fused scans, gate and generic table tests.

A check counts rows of a base relation that meet a predicate. Checks over one base run as one aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.ranking import global_rank
from tidemill.session import cut

ERROR, WARNING = "ERROR", "WARNING"
TYPES = ("referential", "temporal", "business", "uniqueness", "join", "integrity", "lineage", "reconciliation", "row")


@dataclass(frozen=True)
class Check:
    name: str
    type: str
    base: str
    predicate: str
    severity: str = ERROR
    expect: str = "zero"  # or nonzero


def validate(checks: list[Check]) -> None:
    """Duplicate names, unknown types, severities and expectations are errors."""
    names = [c.name for c in checks]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate checks: {sorted({n for n in names if names.count(n) > 1})}")
    for c in checks:
        if c.type not in TYPES or c.severity not in (ERROR, WARNING) or c.expect not in ("zero", "nonzero"):
            raise ValueError(f"check {c.name} is malformed")


class Parent(NamedTuple):
    """A table that a relation's rows point to by its key, and the columns it lends under other names."""

    table: str
    key: str
    on: str
    columns: dict[str, str]


class Relation(NamedTuple):
    """A table with what its rows point to, parents left out where there are none."""

    table: str
    parents: tuple[Parent, ...] = ()

    def needed(self, predicate: str) -> tuple[Parent, ...]:
        words = set(re.findall(r"\w+", predicate))
        return tuple(p for p in self.parents if words & set(p.columns))

    def sql(self) -> str:
        lent = "".join(f", p{n}.{c} AS {name}" for n, p in enumerate(self.parents) for name, c in p.columns.items())
        joins = "".join(f" LEFT JOIN {{{p.table}}} p{n} ON t.{p.on} = p{n}.{p.key}" for n, p in enumerate(self.parents))
        return f"SELECT t.*{lent} FROM {{{self.table}}} t{joins}"

    def rows(self, tables: Mapping[str, DataFrame], parents: tuple[Parent, ...], own: DataFrame | None = None) -> DataFrame:
        out = tables[self.table] if own is None else own
        for n, p in enumerate(parents):
            lent = tables[p.table].select(F.col(p.key).alias(f"_key{n}"), *[F.col(c).alias(name) for name, c in p.columns.items()])
            out = out.join(lent, F.col(p.on) == F.col(f"_key{n}"), "left").drop(f"_key{n}")
        return out


def scans(
    checks: list[Check], relations: Mapping[str, Relation], each: Mapping[str, tuple[tuple[str, str], ...]]
) -> list[tuple[str, tuple[Parent, ...], list[tuple[str, str]]]]:
    """(table, parents, (check, predicate) of all that can be counted in one pass over it): a table is scanned
    once for predicates over its own columns and once, joined to the parents that are asked for, for the others. Checks
    over several tables are parts of several scans."""
    own: dict[str, list[tuple[str, str]]] = {}
    joined: dict[str, tuple[dict[str, Parent], list[tuple[str, str]]]] = {}
    for c in checks:
        for table, predicate in each.get(c.base, ()):
            own.setdefault(table, []).append((c.name, predicate))
        if c.base in relations:
            relation = relations[c.base]
            needed = relation.needed(c.predicate)
            if needed:
                parents, found = joined.setdefault(relation.table, ({}, []))
                parents |= {p.table: p for p in needed}
                found.append((c.name, c.predicate))
            else:
                own.setdefault(relation.table, []).append((c.name, c.predicate))
    return [(t, (), rows) for t, rows in own.items()] + [(t, tuple(parents.values()), rows) for t, (parents, rows) in joined.items()]


def observe_scans(
    checks: list[Check],
    tables: Mapping[str, DataFrame],
    relations: Mapping[str, Relation],
    each: Mapping[str, tuple[tuple[str, str], ...]],
    others: Mapping[str, DataFrame],
) -> DataFrame:
    """As ``observe``, with one aggregation for all predicates of a scan and the counts added up by check. Checks
    on ``others`` run on those."""
    validate(checks)
    parts = [(Relation(table).rows(tables, parents), rows) for table, parents, rows in scans(checks, relations, each)]
    for base in dict.fromkeys(c.base for c in checks if c.base in others):
        parts.append((others[base], [(c.name, c.predicate) for c in checks if c.base == base]))
    return _summed(checks, [_counted(*part) for part in parts])


def _counted(rows: DataFrame, predicates: list[tuple[str, str]]) -> DataFrame:
    """(name, n) of the rows that meet each predicate."""
    counts = rows.agg(*[F.count_if(F.expr(predicate)).alias(f"n{i}") for i, (_, predicate) in enumerate(predicates)])
    named = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"n{i}").alias("n")) for i, (name, _) in enumerate(predicates)])
    return counts.select(F.inline(named))


def _summed(checks: list[Check], counted: list[DataFrame]) -> DataFrame:
    specs = {c.name: c for c in checks}
    about = lambda field: F.create_map(*[F.lit(x) for n, c in specs.items() for x in (n, getattr(c, field))])[F.col("name")].alias(field)
    found = reduce(DataFrame.unionAll, counted).groupBy("name").agg(F.sum("n").alias("observed"))
    return judged(found.select("name", about("type"), about("severity"), about("expect"), "observed"))


class Part(NamedTuple):
    """Rows with the parents that predicates over them ask for."""

    rows: DataFrame
    parents: tuple[Parent, ...]
    predicates: list[tuple[str, str]]

    def of(self, parent: Parent) -> list[tuple[str, str]]:
        """What asks for this parent alone."""
        return [(n, p) for n, p in self.predicates if Relation("", self.parents).needed(p) == (parent,)]

    def across(self) -> list[tuple[str, str]]:
        """What asks for several parents, or none."""
        return [(n, p) for n, p in self.predicates if len(Relation("", self.parents).needed(p)) != 1]

    def by_keys(self) -> bool:
        """Whether all that is asked of several parents is which of them are there."""
        more = {name for p in self.parents for name, column in p.columns.items() if column != p.key}
        return not any(more & _words(predicate) for _, predicate in self.across())


#: Parents that are met at the same time: few fill the last tasks of one with those of the next, and what they have moved is on disk together.
AT_ONCE = 3


def _words(predicate: str) -> set[str]:
    return set(re.findall(r"\w+", predicate))


def observe_apart(
    checks: list[Check],
    tables: Mapping[str, DataFrame],
    relations: Mapping[str, Relation],
    each: Mapping[str, tuple[tuple[str, str], ...]],
    others: Mapping[str, DataFrame],
) -> DataFrame:
    """As ``observe_scans``, where tables are too large for their rows to be moved to one parent after the other: each parent is
    met once, by the keys of all tables that point to it and the columns that are compared with it. What is asked of several
    parents at once is counted on the table itself, which needs only the keys that met no parent. Rows whose keys have
    several parents are joined to all of theirs."""
    validate(checks)
    counted, apart = [], []
    for table, parents, predicates in scans(checks, relations, each):
        part = Part(tables[table], parents, predicates)
        if parents and part.by_keys():
            apart.append(part)
        else:
            counted.append(_counted(Relation(table).rows(tables, parents), predicates))
    for base in dict.fromkeys(c.base for c in checks if c.base in others):
        counted.append(_counted(others[base], [(c.name, c.predicate) for c in checks if c.base == base]))
    found, repeated = _met(apart, tables)
    for part, parents in repeated:
        some = part._replace(rows=_touched(part, parents, tables))
        own = {p.table: _asked_for(some.rows, p, tables[p.table]) for p in part.parents}
        found += [(name, -n) for name, n in _met([some], own)[0]]
        found += [tuple(r) for r in _counted(Relation("").rows(own, part.parents, some.rows), part.predicates).collect()]
    if found:
        counted.append(apart[0].rows.sparkSession.createDataFrame(found, "name string, n long"))
    return _summed(checks, counted)


def _met(parts: list[Part], tables: Mapping[str, DataFrame]) -> tuple[list[tuple[str, int]], list[tuple[Part, list[Parent]]]]:
    """(check, count) as if no key had several parents, and the parts with those of their parents that have such keys."""
    places = {(i, k): p for i, part in enumerate(parts) for k, p in enumerate(part.parents)}
    planned = []
    for table, key in dict.fromkeys((p.table, p.key) for p in places.values()):
        own = [place for place, p in places.items() if (p.table, p.key) == (table, key)]
        pointing = [(parts[i], parts[i].parents[k]) for i, k in own]
        asked = [(n, name, predicate) for n, (part, p) in enumerate(pointing) for name, predicate in part.of(p)]
        planned.append((own, asked, _pass(pointing, asked, tables[table], key), f"met-{table}"))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        written = pool.map(lambda one: cut(*one[2:]), planned)
        passes = [(own, asked, met) for (own, asked, *_), met in zip(planned, written, strict=True)]
    sums = [
        met.groupBy("_of").agg(F.sum("n").alias("n"), F.count("_key").alias("orphans"), F.array(*[F.sum(f"c{j}") for j in range(len(asked))]).cast("array<bigint>").alias("c"))
        .select(F.lit(n).alias("pass"), "*")
        for n, (_, asked, met) in enumerate(passes)
    ]
    found: list[tuple[str, int]] = []
    joined = dict.fromkeys(places, 0)
    orphans: dict[tuple[int, int], DataFrame] = {}
    for r in reduce(DataFrame.unionAll, sums).collect() if sums else ():
        own, asked, met = passes[r["pass"]]
        joined[own[r["_of"]]] = r["n"]
        if r["orphans"]:
            orphans[own[r["_of"]]] = met.where((F.col("_of") == r["_of"]) & F.col("_key").isNotNull()).select("_key")
        found += [(name, count) for (n, name, _), count in zip(asked, r["c"], strict=True) if n == r["_of"]]
    home = [
        _at_home(part, {k: keys for (n, k), keys in orphans.items() if n == i}, tables).select(F.lit(i).alias("part"), "*")
        for i, part in enumerate(parts)
    ]
    repeated = []
    for r in reduce(DataFrame.unionAll, home).collect() if home else ():
        part = parts[r["part"]]
        found += [(name, count) for (name, _), count in zip(part.predicates, r["n"], strict=True)]
        several = [p for k, p in enumerate(part.parents) if len(part.parents) > 1 and joined[r["part"], k] > r["keys"][k]]
        if several:
            repeated.append((part, several))
    return found, repeated


def _pass(pointing: list[tuple[Part, Parent]], asked: list[tuple[int, str, str]], parent: DataFrame, key: str) -> DataFrame:
    """Keys of all tables that point to a parent, met by it: rows and counts of what is asked, by table and by the key that met
    none. Rows without a key are not moved."""
    lent: dict[str, str] = {}
    keys = []
    for n, (part, p) in enumerate(pointing):
        words = set().union(*[_words(predicate) for m, _, predicate in asked if m == n])
        for name, column in p.columns.items():
            if name in words and lent.setdefault(name, column) != column:  # one row of the parent serves all
                raise ValueError(f"{p.table} lends two columns as {name}")
        own = [c for c in part.rows.columns if c in words]
        keys.append(part.rows.where(F.col(p.on).isNotNull()).select(F.lit(n).alias("_of"), F.col(p.on).alias("_key"), *own))
    there = parent.select(F.col(key).alias("_there"), *[F.col(c).alias(name) for name, c in lent.items() if c != key])
    met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), keys).join(there, F.col("_key") == F.col("_there"), "left")
    met = met.withColumns({name: F.col("_there") for name, c in lent.items() if c == key})
    counts = [F.count_if(F.when(F.col("_of") == n, F.expr(predicate))).alias(f"c{j}") for j, (n, _, predicate) in enumerate(asked)]
    return met.groupBy("_of", F.when(F.col("_there").isNull(), F.col("_key")).alias("_key")).agg(F.count("*").alias("n"), *counts)


def _at_home(part: Part, orphans: dict[int, DataFrame], tables: Mapping[str, DataFrame]) -> DataFrame:
    """What needs no parent's row: predicates across parents, whose keys are the rows' own unless they are orphans, and those of one
    parent for rows without its key; with the number of keys for each parent."""
    rows, across = part.rows, part.across()
    if len(part.parents) == 1:  # all else was counted where the keys met the parent, each of its rows by itself
        rows = rows.where(F.col(part.parents[0].on).isNull())
    asked = set().union(*[_words(predicate) for _, predicate in across])
    for k, p in enumerate(part.parents):
        there = F.col(p.on)
        if k in orphans and asked & set(p.columns):
            gone = orphans[k].select(F.col("_key").alias(f"_gone{k}"))
            rows = rows.join(gone, F.col(p.on) == F.col(f"_gone{k}"), "left")
            there = F.when(F.col(f"_gone{k}").isNull(), there)
        kinds = {f.name: f.dataType for f in tables[p.table].schema}
        rows = rows.withColumns({name: there if c == p.key else F.lit(None).cast(kinds[c]) for name, c in p.columns.items()})
    alone = {name: p.on for p in part.parents for name, _ in part.of(p)}
    counts = [F.count_if(F.when(F.col(alone[name]).isNull(), F.expr(predicate)) if name in alone else F.expr(predicate)) for name, predicate in part.predicates]
    return rows.agg(F.array(*counts).alias("n"), F.array(*[F.count(p.on) for p in part.parents]).alias("keys"))


def _touched(part: Part, parents: list[Parent], tables: Mapping[str, DataFrame]) -> DataFrame:
    """The rows that have several of one of these parents."""
    names = {p.on for p in part.parents}.union(*[_words(predicate) for _, predicate in part.predicates])
    rows = part.rows.select(*[c for c in part.rows.columns if c in names])
    for k, p in enumerate(parents):
        several = unique(tables[p.table], p.key).select(F.col(p.key).alias(f"_several{k}"))
        rows = rows.join(several, F.col(p.on) == F.col(f"_several{k}"), "left")
    flags = [f"_several{k}" for k in range(len(parents))]
    return cut(rows.where(reduce(Column.__or__, [F.col(f).isNotNull() for f in flags])).drop(*flags), "touched")


def _asked_for(rows: DataFrame, p: Parent, parent: DataFrame) -> DataFrame:
    """The parent's rows that some rows point to."""
    keys = rows.select(F.col(p.on).alias("_on")).distinct()
    columns = dict.fromkeys((p.key, *p.columns.values()))
    return cut(parent.select(*columns).join(keys, F.col(p.key) == F.col("_on"), "left_semi"), f"asked-{p.table}")


def judged(found: DataFrame) -> DataFrame:
    good = F.when(F.col("expect") == "zero", F.col("observed") == 0).otherwise(F.col("observed") > 0)
    bad = F.when(F.col("severity") == ERROR, "FAIL").otherwise("WARN")
    return found.withColumn("status", F.when(good, "PASS").otherwise(bad))


def observe(checks: list[Check], bases: dict[str, DataFrame]) -> DataFrame:
    """One row per check whose base is given: its count and PASS, WARN or FAIL. One scan per base."""
    validate(checks)
    parts = []
    for base in dict.fromkeys(c.base for c in checks if c.base in bases):
        own = [c for c in checks if c.base == base]
        counts = bases[base].agg(*[F.count_if(F.expr(c.predicate)).alias(c.name) for c in own])
        rows = F.array(
            *[
                F.struct(
                    F.lit(c.name).alias("name"), F.lit(c.type).alias("type"), F.lit(c.severity).alias("severity"),
                    F.lit(c.expect).alias("expect"), F.col(c.name).alias("observed"),
                )
                for c in own
            ]
        )
        parts.append(counts.select(F.inline(rows)))
    return judged(reduce(DataFrame.unionAll, parts))


class QualityError(Exception):
    pass


def gate(observations: DataFrame) -> None:
    """Raises if any check fails; warnings pass."""
    failed = [r["name"] for r in observations.where("status = 'FAIL'").select("name").orderBy("name").limit(50).collect()]
    if failed:
        raise QualityError(f"failed checks: {', '.join(failed)}")


def persist(observations: DataFrame, path: str, run_id: str) -> None:
    observations.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def sql_checks(spark: SparkSession, statements: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Checks as SQL over views; those with an absent table are skipped. name -> (SQL giving one number, tables)."""
    here = {n: s for n, (s, needs) in statements.items() if all(spark.catalog.tableExists(t) for t in needs)}
    parts = [spark.sql(f"SELECT '{n}' AS name, CAST(({s}) AS BIGINT) AS observed") for n, s in here.items()]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "name string, observed long")


# ---------------------------------------------------------------- generic tests, each gives violating rows


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def relationships(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def expression_is_true(df: DataFrame, expression: str) -> DataFrame:
    return df.where(~F.coalesce(F.expr(expression), F.lit(False)))


def has_unknown_member(dim: DataFrame, key: str, unknown: str = "UNKNOWN") -> DataFrame:
    return dim.agg(F.count_if(F.col(key) == unknown).alias("n_unknown")).where("n_unknown <> 1")


def outside_window(resolved: DataFrame, lag: str, most: int) -> DataFrame:
    return resolved.where(F.col(lag) > most).groupBy(F.col(lag)).agg(F.count("*").alias("n"))


def key_checksum(df: DataFrame, key: str, *more: Column) -> DataFrame:
    """Equal before and after a rebuild if keys are stable; ``more`` aggregates come from the same scan."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key)).alias("checksum"), *more)


def compare_systems(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows missing on either side and rows with null-safe different values, counted."""
    both = left.select(key, F.struct(*columns).alias("_l")).join(right.select(key, F.struct(*columns).alias("_r")), key)
    return (
        left.join(right, key, "left_anti").agg(F.count("*").alias("missing_right"))
        .crossJoin(right.join(left, key, "left_anti").agg(F.count("*").alias("missing_left")))
        .crossJoin(both.agg(F.count_if(~F.col("_l").eqNullSafe(F.col("_r"))).alias("different")))
    )


def concentration(df: DataFrame, key: str, measure: str, top: float = 0.1) -> DataFrame:
    """Share of the total that the top part of the keys holds; ranked by ranges of the pre-aggregated table."""
    per_key = df.groupBy(key).agg(F.sum(measure).alias("m"))
    total = per_key.agg(F.sum("m").alias("total"), F.count("*").alias("n"))
    ranked = global_rank(per_key, F.desc("m"), F.col(key))
    return (
        ranked.crossJoin(F.broadcast(total))
        .where(F.col("rank") <= F.ceil(F.col("n") * top))
        .groupBy("total")
        .agg(F.sum("m").alias("top_m"))
        .select(F.round(F.col("top_m").cast("double") / F.col("total").cast("double"), 8).alias("top_share"))
    )

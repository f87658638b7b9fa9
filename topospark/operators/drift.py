"""Result files whose columns drift: every change listed, all rows in one table.

Lines become cells (file, line, field, value). Cells give each column of each file a profile:
its type and a value sketch. Between one file of a campaign and the next, columns that went
and columns that came are matched as a bipartite graph, weighted by the values they share in
the rows both files carry, then by sketch, type and name. What is left was added or removed.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator
from decimal import Decimal
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topospark.session import cut_lineage

DELIMITERS = ",;\t|"
SKETCH = 16
AGREE = 0.8

_INTEGER = re.compile(r"[+-]?\d+")
_NUMBER = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|infinity)", re.IGNORECASE)
_INSIDE = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_PERCENT = re.compile(r"\d\.?\s*%")
_ABSENT = {"", "null", "na", "nan"}

CELLS = "file_id bigint, line_no int, field string, value string, kind int, low double, high double, token string"
INTEGER, NUMBER, TEXT = 1, 2, 3


def _bare(text: str) -> str:
    return text.strip("﻿ \t\r\n").strip("\"'").strip("﻿ \t\r\n")


def read_cell(value: str | None) -> tuple:
    """``(value, kind, low, high, token)`` of a raw value; all null if it is absent.

    ``low`` and ``high`` enclose the number in it (a text may decorate a number, or give a range;
    with a percent sign it counts hundredths);
    ``token`` is equal for equal values in any number format of at least five decimals.
    """
    text = None if value is None else _bare(value)
    if text is None or text.lower() in _ABSENT:
        return None, None, None, None, None
    if _NUMBER.fullmatch(text):
        number = float(text)
        kind = INTEGER if _INTEGER.fullmatch(text) else NUMBER
        return text, kind, number, number, repr(round(number, 5) + 0.0)
    places = -2 if _PERCENT.search(text) else 0
    numbers = [float(Decimal(x).scaleb(places)) for x in _INSIDE.findall(text.replace("..", " "))]
    if len(numbers) == 1:
        return text, TEXT, numbers[0], numbers[0], repr(round(numbers[0], 5) + 0.0)
    if len(numbers) == 2 and re.fullmatch(r"[^\d]*[\d.eE+-]+\s*(?:\.\.|–|to|:)\s*[\d.eE+-]+[^\d]*", text):
        pair = sorted(abs(x) for x in numbers)
        return text, TEXT, pair[0], pair[-1], text.lower()
    return text, TEXT, None, None, text.lower()


def parse_line(line: str, file_format: str, header: str | None, is_header: bool) -> list[tuple[str, str | None]]:
    """Fields and raw values of one line; of a header the fields with no values; nothing if it holds no result."""
    line = line.strip("﻿\r\n")
    if file_format == "jsonl":
        try:
            found = json.loads(line, parse_float=str, parse_int=str, parse_constant=str)
        except ValueError:
            return []
        if not isinstance(found, dict):
            return []
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        return list({_bare(k): text(v) for k, v in found.items()}.items())
    if header is None:
        return []
    header = header.strip("﻿\r\n")
    mark = max(DELIMITERS, key=header.count)
    names = [_bare(x) for x in next(csv.reader([header], delimiter=mark))]
    if is_header:
        return [(n, None) for n in dict.fromkeys(names)]
    values = next(csv.reader([line], delimiter=mark, skipinitialspace=True), [])
    if [_bare(v) for v in values] == names:
        return []  # the header again
    return list({n: v for n, v in zip(reversed(names), reversed(values[: len(names)] + [None] * (len(names) - len(values))), strict=True)}.items())


def read_cells(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells of all lines, columns as in ``CELLS``; a header gives cells without value at its own line.

    Null and blank lines, comments and lines of files not in ``files`` give none; a line that is
    no result in its format gives none. The header is the first other line of a csv file.
    """
    body = lines.select("file_id", "line_no", "line").where(~F.coalesce(F.trim(F.translate("line", "﻿\r\n\t", "")), F.lit("")).rlike("^$|^#"))
    named = files.select("file_id", F.lower(F.trim("file_format")).alias("file_format")).where("file_id is not null").dropDuplicates(["file_id"])
    first = body.groupBy("file_id").agg(F.min("line_no").alias("first_no"), F.min_by("line", "line_no").alias("header"))
    rows = body.join(named.join(first, "file_id"), "file_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, n, line, kind, first_no, header in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for field, value in parse_line(line, kind, header, n == first_no):
                    out.append((file_id, n, field, *read_cell(value)))
            if out:
                types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CELLS.split(", ")])

    return rows.select("file_id", F.col("line_no").cast("int"), "line", "file_format", F.col("first_no").cast("int"), "header").mapInArrow(run, CELLS)


def profiles(cells: DataFrame) -> DataFrame:
    """One row per column of a file: its type (null if all values are absent), count and value sketch (minima of hashes)."""
    sketch = F.array(*[F.min(F.xxhash64("token", F.lit(i))) for i in range(SKETCH)])
    return cells.groupBy("file_id", "field").agg(F.max("kind").alias("type"), F.count("value").alias("present"), sketch.alias("sketch"))


def in_order(files: DataFrame) -> DataFrame:
    """Files of a campaign in order of (written_at, file_id), with their place and the file before."""
    once = files.where("file_id is not null").select("file_id", "campaign_id", "series", "written_at").dropDuplicates(["file_id"])
    w = Window.partitionBy("campaign_id").orderBy("written_at", "file_id")
    return once.select("file_id", "campaign_id", "series", F.row_number().over(w).alias("place"), F.lag("file_id").over(w).alias("before"))


def carried_rows(cells: DataFrame, pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows that a file repeats from the one before: (file_id, before, line_no, line_before).

    Rows are joined on kept columns' values that are alone in their column in both files, so a
    frequent value never multiplies; of the candidates of a row the best stays, if it agrees in
    most of the kept columns both rows have.
    """
    held = cells.where("value is not null")
    alone = held.join(kept, ["file_id", "field"], "left_semi").groupBy("file_id", "field", "token").agg(F.count(F.lit(1)).alias("n"), F.first("line_no").alias("line_no")).where("n = 1")
    next_of = kept.join(pairs, "file_id").select(F.col("before").alias("file_id"), "field", F.col("file_id").alias("next"))
    alone_before = held.join(next_of, ["file_id", "field"]).groupBy("next", "field", "token").agg(F.count(F.lit(1)).alias("n"), F.first("line_no").alias("line_before"), F.first("file_id").alias("before")).where("n = 1")
    votes = alone.join(alone_before.select(F.col("next").alias("file_id"), "field", "token", "line_before", "before"), ["file_id", "field", "token"])
    votes = votes.groupBy("file_id", "before", "line_no", "line_before").agg(F.count(F.lit(1)).alias("votes"))
    best = F.row_number().over(Window.partitionBy("file_id", "line_no").orderBy(F.col("votes").desc(), "line_before"))
    likely = votes.withColumn("best", best).where("best = 1").drop("best", "votes")
    mine = held.join(kept, ["file_id", "field"], "left_semi").select("file_id", "line_no", "field", "token")
    theirs = held.select(F.col("file_id").alias("before"), F.col("line_no").alias("line_before"), "field", F.col("token").alias("other"))
    both = likely.join(mine, ["file_id", "line_no"]).join(theirs, ["before", "line_before", "field"])
    agree = both.groupBy("file_id", "before", "line_no", "line_before").agg(F.avg((F.col("token") == F.col("other")).cast("double")).alias("agree"))
    return agree.where(F.col("agree") >= 0.6).drop("agree")


def same_value(a: str, b: str) -> Column:
    """Whether two cells hold the same value: as numbers within their printed precision, or as equal text."""
    low_a, high_a, low_b, high_b = (F.col(f"{p}_{c}") for c in (a, b) for p in ("low", "high"))
    slack = F.lit(2e-6) + F.lit(1e-3) * F.least(F.abs(high_a), F.abs(high_b))
    numeric = ((low_a <= high_b + slack) & (low_b <= high_a + slack)) | ((high_a == high_b) & (low_a == low_b))
    return F.coalesce(F.when(low_a.isNotNull() & low_b.isNotNull(), numeric), F.col(f"token_{a}") == F.col(f"token_{b}"), F.lit(False))


def _match(edges: pd.DataFrame) -> pd.DataFrame:
    """Heaviest matching of the columns of one file pair, by augmenting along best paths."""
    olds, news = sorted(set(edges.old)), sorted(set(edges.new))
    name = [SequenceMatcher(None, o.lower(), n.lower()).ratio() for o, n in zip(edges.old, edges.new, strict=True)]
    weight = np.full((len(olds), len(news)), -np.inf)
    for o, n, w, s in zip(edges.old, edges.new, edges.weight, name, strict=True):
        weight[olds.index(o), news.index(n)] = w + 0.4 * s
    to_new: dict[int, int] = {}
    for _ in olds:
        # best gain of reaching each new column from an unmatched old one (Bellman-Ford on the residual graph)
        gain = np.full(len(news), -np.inf)
        via = np.full(len(news), -1)
        taken = {n: o for o, n in to_new.items()}
        for o in range(len(olds)):
            if o not in to_new:
                better = weight[o] > gain
                gain[better], via[better] = weight[o][better], o
        for _ in olds:
            for n, o in taken.items():
                step = gain[n] - weight[o, n] + weight[o]
                step[n] = -np.inf
                better = step > gain + 1e-12
                gain[better], via[better] = step[better], o
        free = [n for n in range(len(news)) if n not in taken and np.isfinite(gain[n])]
        if not free or max(gain[free]) <= 0:
            break
        n = max(free, key=lambda x: gain[x])
        while True:
            o = int(via[n])
            freed = to_new.get(o)
            to_new[o] = n
            if freed is None:
                break
            n = freed
    return pd.DataFrame({"file_id": edges.file_id.iloc[0], "old": [olds[o] for o in to_new], "new": [news[n] for n in to_new.values()]})


def renames(cells: DataFrame, profile: DataFrame, pairs: DataFrame, gone: DataFrame, new: DataFrame, kept: DataFrame) -> DataFrame:
    """Renamed columns (file_id, old, new)."""
    both = gone.select("file_id").intersect(new.select("file_id"))
    wanted = pairs.join(both, "file_id", "left_semi")
    rows = carried_rows(cells, wanted, kept.join(both, "file_id", "left_semi"))
    value = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("value", "low", "high", "token")]
    came = cells.join(new, ["file_id", "field"], "left_semi").select("file_id", "line_no", F.col("field").alias("new"), *value("b"))
    went = cells.join(gone.join(pairs, "file_id").select(F.col("before").alias("file_id"), "field"), ["file_id", "field"], "left_semi")
    went = went.select(F.col("file_id").alias("before"), F.col("line_no").alias("line_before"), F.col("field").alias("old"), *value("a"))
    met = rows.join(came, ["file_id", "line_no"]).join(went, ["before", "line_before"]).where("value_a is not null or value_b is not null")
    same = same_value("a", "b").cast("int")
    shared = met.groupBy("file_id", "before", "old", "new").agg(F.sum(same).alias("same"), F.count(F.lit(1)).alias("met"))
    shared = shared.where((F.col("same") > 0) & (F.col("same") >= AGREE * F.col("met")))
    p = lambda c, f: profile.select(F.col("file_id").alias(f), F.col("field").alias(c), F.col("type").alias(f"type_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    shared = shared.join(p("new", "file_id"), ["file_id", "new"]).join(p("old", "before"), ["before", "old"])
    alike = F.size(F.filter(F.zip_with("sketch_old", "sketch_new", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x)) / SKETCH
    weight = 1 + F.col("same") / F.col("met") + F.log1p("same") + 0.3 * alike + F.when(F.col("type_old").eqNullSafe(F.col("type_new")), 0.2).otherwise(0.0)
    edges = shared.select("file_id", "old", "new", weight.alias("weight"))
    return edges.groupBy("file_id").applyInPandas(_match, "file_id bigint, old string, new string")  # a group is at most columns x columns


def compare(files: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """The steps of the comparison: cells, ordered files, and per file the columns with their state.

    ``columns``: file_id, field, type, campaign_id, place, state (first, kept, added or renamed)
    and, if renamed, ``was``; ``removed``: file_id, field.
    """
    cells = cut_lineage(read_cells(files, lines))
    order = cut_lineage(in_order(files))
    profile = cut_lineage(profiles(cells))
    pairs = order.where("before is not null").select("file_id", "before")
    mine = profile.select("file_id", "field").join(pairs.select("file_id"), "file_id")
    theirs = profile.select(F.col("file_id").alias("before"), "field").join(pairs, "before").select("file_id", "field")
    kept, new, gone = mine.intersect(theirs), mine.join(theirs, ["file_id", "field"], "left_anti"), theirs.join(mine, ["file_id", "field"], "left_anti")
    kept, new, gone = cut_lineage(kept), cut_lineage(new), cut_lineage(gone)
    renamed = cut_lineage(renames(cells, profile, pairs, gone, new, kept))
    came = new.join(renamed.select("file_id", F.col("new").alias("field"), F.col("old").alias("was")), ["file_id", "field"], "left")
    came = came.withColumn("state", F.when(F.col("was").isNull(), "added").otherwise("renamed"))
    states = came.unionByName(kept.withColumn("state", F.lit("kept")), allowMissingColumns=True)
    columns = profile.join(order.select("file_id", "campaign_id", "place"), "file_id").join(states, ["file_id", "field"], "left")
    columns = columns.withColumn("state", F.coalesce("state", F.lit("first")))
    removed = gone.join(renamed.select("file_id", F.col("old").alias("field")), ["file_id", "field"], "left_anti")
    return {"cells": cells, "order": order, "columns": cut_lineage(columns), "removed": removed}


def runs(columns: DataFrame) -> DataFrame:
    """Columns with the run of files they belong to and what is known from before it.

    A run is a stretch of files with a column of one name; a rename links a run to the one it
    continues. Added: ``run`` and ``was_run`` keys, ``inherited`` (the type last known before the
    run) and ``root`` (the name the column first had in the campaign).
    """
    by_name = Window.partitionBy("campaign_id", "field").orderBy("place")
    start = F.last(F.when(F.col("state") != "kept", F.col("place")), ignorenulls=True).over(by_name)
    key = lambda field, place: F.struct(F.col("campaign_id"), field.alias("field"), place.alias("start"))
    in_runs = columns.withColumn("run", key(F.col("field"), start))
    known = Window.partitionBy("run").orderBy("place")
    in_runs = in_runs.withColumn("known", F.last("type", ignorenulls=True).over(known.rowsBetween(Window.unboundedPreceding, -1)))
    ends = cut_lineage(in_runs.groupBy("run").agg(F.max_by("type", F.when(F.col("type").isNotNull(), F.col("place"))).alias("last_type"), F.max("place").alias("last_place"), F.first("was", ignorenulls=True).alias("was")))
    # the run before ends where this one starts
    links = ends.where("was is not null").select("run", F.col("run.campaign_id").alias("c"), F.col("was").alias("f"), (F.col("run.start") - 1).alias("p"))
    tails = ends.select(F.col("run.campaign_id").alias("c"), F.col("run.field").alias("f"), F.col("last_place").alias("p"), F.col("run").alias("was_run"), "last_type")
    same = links.c.eqNullSafe(tails.c) & (links.f == tails.f) & (links.p == tails.p)
    chain = cut_lineage(links.join(tails, same).select("run", "was_run", F.col("last_type").alias("inherited"), F.col("was_run.field").alias("root")))
    while not chain.where("was_run is not null").isEmpty():  # doubling: a chain of n renames takes log n rounds
        above = chain.select(F.col("run").alias("was_run"), F.col("was_run").alias("next"), F.col("inherited").alias("older"), F.col("root").alias("first"))
        chain = cut_lineage(chain.join(above, "was_run", "left").select("run", F.col("next").alias("was_run"), F.coalesce("inherited", "older").alias("inherited"), F.coalesce("first", "root").alias("root")))
    chain = chain.select("run", "inherited", "root")
    joined = in_runs.join(chain, "run", "left")
    return joined.withColumn("known", F.coalesce("known", "inherited")).withColumn("root", F.coalesce("root", "field"))


def changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``(file_id, field, change_kind)``, one row per change of a file against the one before in its campaign.

    Kinds: added, removed, renamed, retyped. A file delivered twice is compared like any other; a
    file without results compares as one without columns; null campaigns form one campaign; a
    campaign's first file has no changes. Other columns of the tables are not read.
    """
    found = compare(files, lines)
    columns = found["columns"]
    come = columns.where("state in ('added', 'renamed')").select("file_id", "field", F.col("state").alias("change_kind"))
    went = found["removed"].select("file_id", "field", F.lit("removed").alias("change_kind"))
    typed = runs(columns).where("state in ('kept', 'renamed') and type <> known").select("file_id", "field", F.lit("retyped").alias("change_kind"))
    return reduce(DataFrame.unionByName, [come, went, typed])


def plain_name(column: Column) -> Column:
    """A field name without case and separators."""
    return F.lower(F.regexp_replace(column, r"[^\p{L}\p{N}]", ""))


def standard_names(columns: DataFrame, standard: list[str]) -> DataFrame:
    """``(file_id, field, name)``: the standard column each column of a file belongs to, null if none.

    A column goes by the name it first had in its campaign; a name that never was a standard one
    there goes by what the same name was in most files of other campaigns.
    """
    spark = columns.sparkSession
    known = spark.createDataFrame([(re.sub(r"[^a-z0-9]", "", s.lower()), s) for s in standard], "plain string, name string")
    traced = runs(columns).select("file_id", "field", plain_name(F.col("field")).alias("own"), plain_name(F.col("root")).alias("plain"))
    traced = cut_lineage(traced.join(known, "plain", "left"))
    votes = traced.where("name is not null").groupBy("own", "name").agg(F.count(F.lit(1)).alias("n"))
    usual = votes.groupBy("own").agg(F.max_by("name", F.struct("n", "name")).alias("usual"))
    return traced.join(usual, "own", "left").select("file_id", "field", F.coalesce("name", "usual").alias("name"))


def read_loaded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns of a loaded table as the numbers that ``read_cell`` finds in them, what has none in the map ``other``."""
    kept = [f for f in df.schema.fields if f.name not in columns]
    plain = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    schema = ", ".join([*plain, *[f"`{c}` double" for c in columns], "other map<string, string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, others = [], [[] for _ in range(batch.num_rows)]
            for c in columns:
                found = [read_cell(v) for v in batch.column(c).to_pylist()]
                numbers.append(pa.array([None if low is None else (low + high) / 2 for _, _, low, high, _ in found], pa.float64()))
                for held, (value, _, low, _, _) in zip(others, found, strict=True):
                    if value is not None and low is None:
                        held.append((c, value))
            other = pa.array([held or None for held in others], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *numbers, other], [*[f.name for f in kept], *columns, "other"])

    return df.mapInArrow(run, schema)


def unify(files: DataFrame, lines: DataFrame, loaded: dict[str, DataFrame], texts: tuple[str, ...] = ("dataset", "method")) -> DataFrame:
    """All result rows under one set of columns: those of the delivered files and those of the loaded tables.

    Columns: ``origin`` (a loaded table's name, else the file's series), campaign_id, file_id,
    line_no, run_id, run_at, the standard columns (double, but for ``texts``) and ``other``, a map
    of values whose column has no standard name, or that hold no number where the standard column
    is one. Texts of files and of loaded tables are read alike: a number is taken out of a text
    that decorates it, of a range the middle, of a percentage the hundredth; what is absent, or
    NaN in a loaded table, is null. Rows that files repeat are kept, with their origin.
    """
    standard = list(dict.fromkeys(c for df in loaded.values() for c in df.columns if c not in ("run_id", "run_at")))
    found = compare(files, lines)
    names = standard_names(found["columns"], standard)
    number = (F.col("low") + F.col("high")) / 2
    cells = found["cells"].where("value is not null").join(names, ["file_id", "field"])
    wide = cells.groupBy("file_id", "line_no").agg(
        *[F.max(F.when(F.col("name") == c, F.col("value") if c in texts else number)).alias(c) for c in standard],
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("name").isNull() | (~F.col("name").isin(*texts) & number.isNull()), F.struct("field", "value"))))).alias("other"),
    )
    order = found["order"].select("file_id", "campaign_id", F.col("series").alias("origin"))
    rows = wide.join(order, "file_id")
    for table, df in loaded.items():
        written = [c for c in standard if c in df.columns and c not in texts and df.schema[c].dataType.typeName() in ("string", "varchar", "char")]
        typed = [F.col(c).cast("string").alias(c) if c in texts else F.col(c) if c in written else F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None)).alias(c) for c in standard if c in df.columns]
        own = df.select("run_id", "run_at", *typed)
        own = read_loaded(own, written) if written else own
        rows = rows.unionByName(own.withColumn("origin", F.lit(table)), allowMissingColumns=True)
    return rows.select("origin", "campaign_id", "file_id", "line_no", "run_id", "run_at", *standard, "other")

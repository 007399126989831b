"""Schemas that drift between files: lifespans, changes, one table out of all.

The catalogue is built from declared schemas (footer metadata): schemas are read
once, files of a producer (data set) are put in order, successive files with the
same schema are joined into versions, versions are exploded into fields, and for
each producer, field and type ``lag`` over the versions gives islands: a field's
lifespans. Their starts and endings are the log from which each change follows.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions.schemas import classify, declared_fields, flatten, match_fields, signature
from siftlake.operators.heavy import skew_join
from siftlake.plans.ordered import gap_islands, ordered_scan
from siftlake.plans.shared import cut

FIELD = "struct<outer: array<string>, step: string, name: string, type: string, id: bigint, former: string>"
#: Texts of schemas that a worker remembers, so that a schema repeated in many files is read once.
REMEMBERED = 4096


def _read_schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, tuple[str, list]] = {}
    told: set[str] = set()
    field = pa.struct(
        [("outer", pa.list_(pa.string())), ("step", pa.string()), ("name", pa.string()), ("type", pa.string()), ("id", pa.int64()), ("former", pa.string())]
    )
    for batch in batches:
        signs, fields = [], []
        for texts in zip(batch["file_schema"].to_pylist(), batch["sql_schema"].to_pylist()):
            if texts not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                flat = flatten(declared_fields(*texts))
                known[texts] = signature(flat), flat
            sign, flat = known[texts]
            signs.append(sign)
            fields.append(None if sign in told else flat)
            told.add(sign)
        yield pa.record_batch(
            [batch["file_id"], batch["dataset_id"], batch["modification_time"], pa.array(signs), pa.array(fields, pa.list_(field))],
            ["file_id", "dataset_id", "modification_time", "sign", "fields"],
        )


class DriftCatalogue:
    """Lifespans of the fields of each data set and what follows from them.

    Files are ordered by ``modification_time`` (equal times by ``file_id``, nulls
    first); rows without ``file_id`` or ``dataset_id``, and files where both schemas
    are null, take no part. Repeated rows of a file count once. A schema that can't
    be read has no fields. Other columns of the input are ignored.
    """

    def __init__(self, file_status: DataFrame):
        declared = file_status.select("file_id", "dataset_id", "modification_time", "file_schema", "sql_schema").filter(
            "file_id is not null and dataset_id is not null and (file_schema is not null or sql_schema is not null)"
        )
        read = cut(
            declared.mapInArrow(
                _read_schemas, f"file_id bigint, dataset_id bigint, modification_time bigint, sign string, fields array<{FIELD}>"
            ),
            "schemas",
        )
        #: sign -> fields, each distinct schema once
        self.schemas = read.filter("fields is not null").groupBy("sign").agg(F.first("fields").alias("fields"))
        files = (
            read.groupBy("file_id")
            .agg(F.min(F.struct("dataset_id", "modification_time", "sign")).alias("x"))
            .select("file_id", "x.*")
        )
        order = ["modification_time", "file_id"]
        #: all files in order, each with the schema of the one before
        self.files = ordered_scan(files, ["dataset_id"], order, lag=["sign"], seq="file_no")
        turns = self.files.filter("prev_sign is null or prev_sign != sign")
        #: files whose schema differs from the one before, numbered within the data set
        self.versions = cut(
            ordered_scan(turns, ["dataset_id"], order, seq="version"), "versions"
        )

    def file_versions(self) -> DataFrame:
        """(dataset_id, file_id, sign, version): the version that each file belongs to."""
        turn = F.when(F.col("prev_sign").isNull() | (F.col("prev_sign") != F.col("sign")), 1).otherwise(0)
        marked = self.files.withColumn("turn", turn)
        counted = ordered_scan(marked, ["dataset_id"], ["file_no"], sums={"before": F.col("turn")}, seq="n")
        return counted.select("dataset_id", "file_id", "sign", (F.col("before") + F.col("turn")).alias("version"))

    @cached_property
    def _fields(self) -> DataFrame:
        """(sign, fid, field): each field of each distinct schema; ``fid`` stands for a name, place, id and type."""
        fid = F.xxhash64(F.concat_ws("\x1e", "field.outer", "field.step", "field.type", F.coalesce("field.former", F.lit("\x1d"))))
        return cut(self.schemas.select("sign", F.explode("fields").alias("field")).select("sign", fid.alias("fid"), "field"), "fields")

    def field_versions(self) -> DataFrame:
        """(dataset_id, version, fid): each field of each version, as numbers only. A few schemas may be those of most versions, hence ``skew_join``."""
        fids = self._fields.groupBy("sign").agg(F.collect_list("fid").alias("fids"))
        return skew_join(self.versions.select("dataset_id", "version", "sign"), fids, "sign").select("dataset_id", "version", F.explode("fids").alias("fid"))

    @cached_property
    def _spans(self) -> DataFrame:
        return cut(gap_islands(self.field_versions(), ["dataset_id", "fid"], "version"), "lifespans")

    @cached_property
    def _known(self) -> DataFrame:
        return cut(self._fields.groupBy("fid").agg(F.first("field").alias("field")), "known-fields")

    def lifespans(self) -> DataFrame:
        """(dataset_id, fid, first_pos, last_pos, field): versions from which to which a field of one name, place, id and type ran without a gap."""
        return skew_join(self._spans, self._known, "fid").select("dataset_id", "fid", "first_pos", "last_pos", "field")

    def _events(self) -> DataFrame:
        """Starts and endings, as numbers only."""
        events = self._spans.select(
            "dataset_id",
            "fid",
            F.explode(
                F.array(
                    F.struct(F.col("first_pos").alias("version"), F.lit("started").alias("event")),
                    F.struct((F.col("last_pos") + 1).alias("version"), F.lit("ended").alias("event")),
                )
            ).alias("e"),
        )
        return events.select("dataset_id", "e.version", "e.event", "fid").filter("version > 1")

    def log(self) -> DataFrame:
        """Starts and endings: (dataset_id, version, event, field), of which an ending stands at the first version without the field."""
        return skew_join(self._events(), self._known, "fid").drop("fid")

    def changes(self) -> DataFrame:
        """(dataset_id, file_id, field_name, change_kind): every field that a file adds, renames, removes or retypes against the file before it."""
        at = self.versions.filter("prev_sign is not null").withColumn("turn", F.concat("prev_sign", "sign"))
        # what a turn from one schema to another changes is told once, from the log of the first version that takes it
        first = at.groupBy("turn").agg(F.min(F.struct("dataset_id", "version")).alias("x")).select("turn", "x.*")
        side = lambda name: F.collect_list(F.when(F.col("event") == name, F.col("field"))).alias(name)
        of_turns = self._events().join(first, ["dataset_id", "version"]).join(self._known, "fid")
        turns = of_turns.groupBy("turn").agg(side("ended"), side("started"))
        told = cut(turns.mapInArrow(_classify, "turn string, field_name string, change_kind string"), "turns")
        return skew_join(at.select("dataset_id", "file_id", "turn"), told, "turn").drop("turn")

    def schema_history(self) -> DataFrame:
        """The catalogue for readers: (dataset_id, field_name, field_type, first_file, last_file, first_no, last_no); ``last_file`` is the file that begins the last version with the field."""
        at = self.versions.select("dataset_id", F.col("version").alias("v"), "file_id", "file_no")
        spans = self.lifespans().select(
            "dataset_id",
            F.concat_ws(".", F.transform("field.outer", lambda x: F.substring_index(x, "\x1f", 1)), "field.name").alias("field_name"),
            F.col("field.type").alias("field_type"),
            "first_pos",
            "last_pos",
        )
        first = at.select("dataset_id", F.col("v").alias("first_pos"), F.col("file_id").alias("first_file"), F.col("file_no").alias("first_no"))
        last = at.select("dataset_id", F.col("v").alias("last_pos"), F.col("file_id").alias("last_file"), F.col("file_no").alias("last_no"))
        return (
            spans.join(first, ["dataset_id", "first_pos"])
            .join(last, ["dataset_id", "last_pos"])
            .select("dataset_id", "field_name", "field_type", "first_file", "last_file", "first_no", "last_no")
        )

    def aliases(self) -> DataFrame:
        """The alias table (dataset_id, old_name, name, field_id, first_pos, last_pos): top-level names that lead to another column, and the versions in which they do."""
        return self.casts().filter("old_name != name").select("dataset_id", "old_name", "name", "field_id", "first_pos", "last_pos")

    def casts(self) -> DataFrame:
        """One consistent schema per data set and how each old form gets into it: (dataset_id, old_name, old_type, name, type, cast_sql,
        field_id, first_pos, last_pos), a row for each run of versions in which a column had that form. Structs are built from the fields inside
        them by the same rules; a struct that is another type elsewhere becomes JSON text. Types widen to the narrowest type that
        holds all forms, else to string.

        Fields are followed from version to version by the rules of ``changes``, with ids kept in mind through files without, so a name that is used
        again for another field has a column of its own; a field that comes back (by id, or by name where one has no id) gets its old column.
        Columns have the latest name of their field; where two differ in letter case at most, the one that is gone longer, else the younger,
        has a suffix. A data set streams through one task, which holds its fields and their forms.
        """
        spans = self.lifespans()
        events = spans.select(
            "dataset_id",
            "field",
            F.explode(
                F.array(
                    F.struct(F.col("first_pos").alias("version"), F.lit(True).alias("starts")),
                    F.struct((F.col("last_pos") + 1).alias("version"), F.lit(False).alias("starts")),
                )
            ).alias("e"),
        ).select("dataset_id", "e.version", "e.starts", "field")
        ordered = events.repartition("dataset_id").sortWithinPartitions("dataset_id", "version")
        return ordered.mapInArrow(_casts, CAST)


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for turn, ended, started in zip(*(batch[c].to_pylist() for c in ("turn", "ended", "started"))):
            rows += [(turn, name, kind) for name, kind in dict.fromkeys(classify(ended, started))]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["turn", "field_name", "change_kind"])


class _Column:
    """A field followed through the versions of a data set, with the columns inside it."""

    def __init__(self, outer: _Column | None, version: int):
        self.outer, self.first, self.last = outer, version, None
        self.name = self.type = self.id = None
        self.inner: list[_Column] = []
        self.types: set[str] = set()
        #: form -> its number, and runs (number of the form, first version, last version) of a top-level column
        self.forms: dict[tuple, int] = {}
        self.runs: list[list] = []
        self.target = self.target_type = ""

    def take(self, field: dict) -> None:
        self.name, self.type, self.last = field["name"], field["type"], None
        self.id = self.id if field["id"] is None else field["id"]
        self.types.add(self.type)

    def form(self) -> tuple:
        """Name, id, type and the forms inside, as they are now."""
        return self.name, self.id, self.type, tuple((n, k.form()) for n, k in enumerate(self.inner) if k.last is None) if self.type == "struct" else ()


class _DataSet:
    """The columns of a data set; ``turn`` takes what ends and starts with a version, in the order of versions."""

    def __init__(self):
        self.root = _Column(None, 0)
        self.at: dict[tuple, _Column] = {}

    def turn(self, version: int, ended: list[dict], started: list[dict]) -> None:
        place = lambda f: (*f["outer"], f["step"])
        touched: dict[int, _Column] = {}
        old = {place(f): self.at.pop(place(f)) for f in ended if place(f) in self.at}
        ended = [f for f in ended if place(f) in old]
        for depth in range(1 + max((len(f["outer"]) for f in [*ended, *started]), default=0)):
            levels: dict[int, tuple[_Column, list, list]] = {}
            for f in ended:
                if len(f["outer"]) == depth:
                    outer = old[place(f)].outer
                    levels.setdefault(id(outer), (outer, [], []))[1].append({**f, "id": old[place(f)].id})
            for f in started:
                if len(f["outer"]) == depth:
                    outer = self.at[tuple(f["outer"])] if depth else self.root
                    levels.setdefault(id(outer), (outer, [], []))[2].append(f)
            for outer, gone, come in levels.values():
                # fields of a struct that is gone, is new or has become one stand against none
                pairs, _, added = match_fields(gone, come)
                for g in gone:
                    old[place(g)].last = version - 1
                for g, c in pairs:
                    self._put(old[place(g)], c, touched)
                for c in added:
                    self._put(self._again(outer, c) or self._new(outer, version), c, touched)
                for g in gone:
                    self._touch(old[place(g)], touched)
        for column in touched.values():
            if column.runs and column.runs[-1][2] is None:
                column.runs[-1][2] = version - 1
            if column.last is None:
                column.runs.append([column.forms.setdefault(column.form(), len(column.forms)), version, None])

    def _put(self, column: _Column, field: dict, touched: dict) -> None:
        column.take(field)
        self.at[(*field["outer"], field["step"])] = column
        self._touch(column, touched)

    def _touch(self, column: _Column, touched: dict) -> None:
        while column.outer is not self.root:
            column = column.outer
        touched[id(column)] = column

    def _new(self, outer: _Column, version: int) -> _Column:
        outer.inner.append(_Column(outer, version))
        return outer.inner[-1]

    def _again(self, outer: _Column, field: dict) -> _Column | None:
        """The column of a field that was there before, the last one that went first."""
        gone = sorted((k for k in outer.inner if k.last is not None), key=lambda k: -k.last)
        by_id = (k for k in gone if k.id is not None and k.id == field["id"])
        by_name = (k for k in gone if k.name == field["name"] and (k.id is None or field["id"] is None))
        return next(by_id, None) or next(by_name, None)

    def rows(self) -> Iterator[tuple]:
        _settle(self.root)
        for column in self.root.inner:
            told = [(f[0], f[1], _form_type(f), f"{_cast(column, f, _quoted(f[0]))} AS {_quoted(column.target)}") for f in column.forms]
            runs: list[list] = []
            for form, first, last in column.runs:
                if runs and runs[-1][0] == told[form] and runs[-1][2] == first - 1:
                    runs[-1][2] = last
                else:
                    runs.append([told[form], first, last])
            for (name, ident, kind, sql), first, last in runs:
                yield name, kind, column.target, column.target_type, sql, ident, first, last


def _settle(outer: _Column) -> None:
    """Names, unlike in more than letter case, and types of the columns inside ``outer``."""
    taken = {k.name.lower() for k in outer.inner}
    first: set[str] = set()
    for column in sorted(outer.inner, key=lambda k: (k.last is not None, -(k.last or 0), k.first)):
        name, n = column.name, 1
        if name.lower() in first:
            while name.lower() in taken:
                n += 1
                name = f"{column.name}_{n}"
            taken.add(name.lower())
        first.add(name.lower())
        column.target = name
    for column in outer.inner:
        _settle(column)
        if column.types == {"struct"}:
            column.target_type = _struct_type([(k.target, k.target_type) for k in column.inner])
        else:
            column.target_type = "string" if "struct" in column.types else wider_type(sorted(column.types))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _struct_type(fields: list[tuple[str, str]]) -> str:
    if not fields:
        return "struct"
    return "struct<" + ",".join(f"{n if n.isascii() and n.isidentifier() else _quoted(n)}:{t}" for n, t in fields) + ">"


def _form_type(form: tuple) -> str:
    return _struct_type(sorted((f[0], _form_type(f)) for _, f in form[3])) if form[2] == "struct" else form[2]


def _cast(column: _Column, form: tuple, value: str) -> str:
    if "struct" not in column.types:
        return value if form[2] == column.target_type else f"CAST({value} AS {column.target_type})"
    if column.types != {"struct"}:
        return f"to_json({value})" if form[2] == "struct" else value if form[2] == "string" else f"CAST({value} AS string)"
    if not column.inner:
        return value
    # by name and in one order, whatever the order in the file
    have, parts = dict(form[3]), []
    for n, k in enumerate(column.inner):
        name = k.target.replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"'{name}', " + (_cast(k, have[n], f"{value}.{_quoted(have[n][0])}") if n in have else f"CAST(NULL AS {k.target_type})"))
    return f"CASE WHEN {value} IS NOT NULL THEN named_struct({', '.join(parts)}) END"


CAST = "dataset_id bigint, old_name string, old_type string, name string, type string, cast_sql string, field_id bigint, first_pos bigint, last_pos bigint"


def _casts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), *[pa.string()] * 5, *[pa.int64()] * 3]
    names = [x.split()[0] for x in CAST.split(", ")]

    def events() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("dataset_id", "version", "starts", "field")))

    out: list[tuple] = []
    for d, of_set in itertools.groupby(events(), key=lambda e: e[0]):
        known, final = _DataSet(), 0
        for v, of_version in itertools.groupby(of_set, key=lambda e: e[1]):
            ended, started = [], []
            for _, _, starts, field in of_version:
                (started if starts else ended).append(field)
            known.turn(v, ended, started)
        for row in known.rows():
            out.append((d, *row))
            if len(out) >= 4096:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


#: Number types from narrow to wide.
NUMBERS = ["byte", "short", "integer", "long", "float", "double"]


def wider_type(types: list[str]) -> str:
    """Narrowest Spark type that holds all values of all of ``types``, so that no cast to it fails or loses a digit."""
    kinds = sorted(set(types))
    if len(kinds) == 1:
        return kinds[0]
    if all(k in NUMBERS for k in kinds):
        if any(k in ("float", "double") for k in kinds):
            # a double holds no long of more than 53 bits
            return "string" if "long" in kinds else "double"
        return max(kinds, key=NUMBERS.index)
    decimals = [k for k in kinds if k.startswith("decimal(")]
    if all(k in NUMBERS[:4] or k in decimals for k in kinds):
        whole = {"byte": (3, 0), "short": (5, 0), "integer": (10, 0), "long": (20, 0)}
        sizes = [whole[k] if k in whole else tuple(map(int, k[8:-1].split(","))) for k in kinds]
        scale = max(s for _, s in sizes)
        digits = max(p - s for p, s in sizes)
        return f"decimal({digits + scale},{scale})" if digits + scale <= 38 else "string"
    if set(kinds) == {"date", "timestamp"}:
        return "timestamp"
    return "string"


def footer_status(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file_id, dataset_id, modification_time, file_schema, sql_schema) of the Parquet files below ``paths``, from their footers, as one data set."""
    from siftlake.sources.footers import file_schemas

    found = file_schemas(spark, paths)
    return cut(
        found.select(
            "path", F.xxhash64("path").alias("file_id"), F.lit(0).cast("long").alias("dataset_id"), F.unix_millis("modified").alias("modification_time"),
            F.lit(None).cast("string").alias("file_schema"), F.col("schema").alias("sql_schema"),
        ),
        "footer-status",
    )


def read_consistent(spark: SparkSession, paths: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Read Parquet files of differing schemas as one table.

    The footers of the files make a catalogue, in the order of their times, and its ``casts`` tell how each
    version of the schema gets into the one consistent schema: fields are followed through renames by
    id and former name, a name used again has a column of its own, columns get the narrowest type
    that holds all their values, inside structs too, and columns that a file lacks
    are null. With ``aliases`` (old top-level name to present name) these names decide instead. ``paths`` may be
    directories. Files that are read alike make one part of the plan; their names come to the
    driver only where Spark's own listing needs them. An empty list raises ``ValueError``, and so does,
    with ``aliases``, a file of which two fields would get one name; columns come in the order of their first sighting.
    """
    status = footer_status(spark, paths)
    if aliases:
        groups = [(k, T.StructType.fromJson(json.loads(k)), files) for k, files in _grouped(status.select(F.col("sql_schema").alias("key"), "path"))]
        return _read_by_names(spark, [(schema, files) for _, schema, files in groups], aliases)
    catalogue = DriftCatalogue(status)
    casts = cut(catalogue.casts(), "casts")
    # one list of casts for each version; versions with the same list and schema are read together
    each = casts.select(F.explode(F.sequence("first_pos", "last_pos")).alias("version"), F.struct("old_name", "name", "type", "cast_sql").alias("c"))
    lists = each.groupBy("version").agg(F.to_json(F.array_sort(F.collect_list("c"))).alias("list"))
    placed = catalogue.file_versions().join(lists, "version", "left").join(status.select("file_id", "path", "sql_schema"), "file_id")
    keyed = placed.select(F.to_json(F.struct("sql_schema", "list")).alias("key"), "path", "version")
    groups = [(json.loads(k), files) for k, files in _grouped(keyed)]
    if not groups:
        raise ValueError("no Parquet files to read")
    final: dict[str, str] = {}
    for key, _ in groups:
        by_old = {c["old_name"]: c for c in json.loads(key.get("list") or "[]")}
        for f in T.StructType.fromJson(json.loads(key["sql_schema"])).fields:
            if f.name in by_old:
                final.setdefault(by_old[f.name]["name"], by_old[f.name]["type"])
    parts = []
    for key, files in groups:
        have = {c["name"]: c["cast_sql"].rsplit(" AS ", 1)[0] for c in json.loads(key.get("list") or "[]")}
        df = spark.read.schema(T.StructType.fromJson(json.loads(key["sql_schema"]))).parquet(*files)
        parts.append(df.select([F.expr(have.get(n, "NULL")).cast(t).alias(n) for n, t in final.items()]))
    return functools.reduce(DataFrame.unionByName, parts)


def _grouped(keyed: DataFrame) -> Iterator[tuple[str, list[str]]]:
    """Files of each ``key``, in the order of the smallest version, or path, of each. Spark sorts them; a group at a time is put together here."""
    by = "version" if "version" in keyed.columns else "path"
    first = keyed.groupBy("key").agg(F.min(by).alias("first"))
    rows = keyed.join(first, "key").orderBy("first", "key", "path").select("key", "path").toLocalIterator()
    for key, group in itertools.groupby(rows, key=lambda r: r["key"]):
        yield key, [r["path"] for r in group]


def _read_by_names(spark: SparkSession, groups: list[tuple[T.StructType, list[str]]], aliases: dict[str, str]) -> DataFrame:
    if not groups:
        raise ValueError("no Parquet files to read")
    final: dict[str, list[T.DataType]] = {}
    for schema, files in groups:
        names = [aliases.get(f.name, f.name) for f in schema.fields]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"{files[0]} has several fields for {', '.join(twice)}; its names need aliases of their own")
        for f, name in zip(schema.fields, names):
            final.setdefault(name, []).append(f.dataType)
    kinds = {name: _widest(types) for name, types in final.items()}
    parts = []
    for schema, files in groups:
        df = spark.read.schema(schema).parquet(*files)
        have = {aliases.get(f.name, f.name): _fitted(F.col(_quoted(f.name)), f.dataType, kinds[aliases.get(f.name, f.name)]) for f in schema.fields}
        parts.append(df.select([have[n].alias(n) if n in have else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]))
    return functools.reduce(DataFrame.unionByName, parts)


def _widest(types: list[T.DataType]) -> T.DataType:
    """The type that holds all of ``types``; structs have the fields of all of them."""
    if all(isinstance(t, T.StructType) for t in types):
        inner: dict[str, list[T.DataType]] = {}
        for t in types:
            for f in t.fields:
                inner.setdefault(f.name, []).append(f.dataType)
        return T.StructType([T.StructField(n, _widest(k)) for n, k in inner.items()])
    if all(t == types[0] for t in types):
        return types[0]
    names = [t.simpleString() for t in types]
    long_names = {"int": "integer", "bigint": "long", "smallint": "short", "tinyint": "byte"}
    wide = wider_type([long_names.get(t, "timestamp" if t == "timestamp_ntz" and len(set(names)) > 1 else t) for t in names])
    return next((t for t, n in zip(types, names) if long_names.get(n, n) == wide), None) or T.DataType.fromDDL(wide)


def _fitted(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if isinstance(want, T.StructType):
        own = {f.name: f.dataType for f in have.fields}
        parts = [_fitted(value.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*[p.alias(f.name) for p, f in zip(parts, want.fields)])) if parts else value
    if have == want:
        return value
    return F.to_json(value) if isinstance(have, T.StructType) and isinstance(want, T.StringType) else value.try_cast(want)

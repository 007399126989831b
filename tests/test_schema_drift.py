import json

import pytest
from conftest import rows

from siftlake.functions.schemas import declared_fields, flatten, read_message_schema
from pyspark.sql import functions as F

from siftlake.operators.schema_drift import DriftCatalogue, read_consistent, wider_type

SCHEMA = "file_id bigint, dataset_id bigint, modification_time bigint, file_schema string, sql_schema string, seq int, version string"


def struct(*fields):
    out = []
    for f in fields:
        name, kind, meta = (*f, {})[:3]
        out.append({"name": name, "type": kind, "nullable": True, "metadata": meta})
    return {"type": "struct", "fields": out}


def files(spark, *schemas):
    return spark.createDataFrame([(i, 1, i * 10, m, None if s is None else s if isinstance(s, str) else json.dumps(s), 0, "x") for i, (m, s) in enumerate(schemas, 1)], SCHEMA)


def found(spark, *schemas):
    return rows(DriftCatalogue(files(spark, *schemas)).changes().select("file_id", "field_name", "change_kind"))


def test_added_removed_retyped_and_case(spark):
    got = found(
        spark,
        (None, struct(("a", "long"), ("b", "string"))),
        (None, struct(("a", "integer"), ("c", "string"))),
        (None, struct(("A", "integer"), ("c", "string"))),
    )
    assert got == [(2, "a", "type_changed"), (2, "b", "removed"), (2, "c", "added"), (3, "A", "added"), (3, "a", "removed")]


def test_ids_then_names_then_former_names(spark):
    ident = lambda n: {"parquet.field.id": n}
    got = found(
        spark,
        (None, struct(("a", "long", ident(1)), ("b", "long", ident(2)), ("c", "long"))),
        (None, struct(("b", "long", ident(1)), ("a", "double", ident(2)), ("d", "long", {"former_name": "c"}))),
    )
    assert got == [(2, "a", "renamed"), (2, "a", "type_changed"), (2, "b", "renamed"), (2, "d", "renamed")]
    # equal names with two different ids are two fields
    assert found(spark, (None, struct(("a", "long", ident(1)))), (None, struct(("a", "long", ident(9))))) == [(2, "a", "added"), (2, "a", "removed")]


def test_structs(spark):
    inner = lambda *f: struct(*f)
    got = found(
        spark,
        (None, struct(("s", inner(("x", "long"), ("y", "long"))), ("t", inner(("q", "long"))))),
        (None, struct(("place", inner(("x", "string"), ("z", "long")), {"former_name": "s"}), ("t", "string"))),
    )
    assert got == [(2, "place", "renamed"), (2, "place.x", "type_changed"), (2, "place.y", "removed"), (2, "place.z", "added"), (2, "t", "type_changed")]


def test_order_nullability_and_broken_schemas(spark):
    message = "message m {\n  optional int64 a = 1;\n  required binary b (STRING);\n  optional int96 t;\n}\n"
    sql = struct(("t", "timestamp"), ("b", "string"), ("a", "long", {"comment": "x"}))
    assert found(spark, (message, None), (None, sql), (message, '{"type":"struct"'), (message, "{}"), (None, None)) == []


def test_message_types():
    text = """message m {
      optional group l (LIST) { repeated group list { optional int32 element; } }
      optional group k (MAP) { repeated group key_value { required binary key (UTF8); optional double value; } }
      repeated float r;
      optional fixed_len_byte_array(9) d (DECIMAL(20,0));
      optional int64 t (TIMESTAMP(MICROS,true)) = 7;
      optional int32 u (INTEGER(16,false));
      optional group s { optional boolean f; }
    }"""
    got = {f["name"]: (f["type"], f["id"]) for f in flatten(read_message_schema(text))}
    assert got == {"l": ("array<integer>", None), "k": ("map<string,double>", None), "r": ("array<float>", None), "d": ("decimal(20,0)", None), "t": ("timestamp", 7), "u": ("integer", None), "s": ("struct", None), "f": ("boolean", None)}
    assert declared_fields("", None) == [] and read_message_schema("message m {") is None


def test_repeats_nulls_and_nothing(spark):
    df = files(spark, (None, struct(("a", "long"))), (None, struct(("b", "long"))))
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, None, None, "x", "y", 1, "z")], SCHEMA))
    assert len(rows(DriftCatalogue(twice).changes())) == 2
    empty = DriftCatalogue(df.limit(0))
    assert empty.changes().count() == empty.schema_history().count() == empty.casts().count() == 0


def test_lifespans_and_casts(spark):
    df = files(
        spark,
        (None, struct(("a", "integer"), ("b", "long"))),
        (None, struct(("a", "long"), ("b", "long"))),
        (None, struct(("n", "long", {"former_name": "a"}), ("b", "long"))),
    )
    c = DriftCatalogue(df)
    assert rows(c.schema_history().select("field_name", "field_type", "first_file", "last_file")) == [("a", "integer", 1, 1), ("a", "long", 2, 2), ("b", "long", 1, 3), ("n", "long", 3, 3)]
    casts = rows(c.casts().select("old_name", "old_type", "name", "type", "cast_sql"))
    assert ("a", "integer", "n", "long", "CAST(`a` AS long) AS `n`") in casts and ("b", "long", "b", "long", "`b` AS `b`") in casts


def test_wider_type():
    f = wider_type
    assert f(["integer", "long"]) == "long" and f(["integer", "double"]) == "double" and f(["long", "double"]) == "string" and f(["date", "timestamp"]) == "timestamp"
    assert f(["decimal(10,2)", "decimal(8,4)"]) == "decimal(12,4)" and f(["integer", "decimal(10,2)"]) == "decimal(12,2)" and f(["boolean", "long"]) == "string"
    assert f(["decimal(38,0)", "decimal(38,10)"]) == "string" and f(["decimal(10,2)", "double"]) == "string"


def test_read_consistent(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as int) a", "id b").write.parquet(f"{tmp_path}/x")
    spark.range(3).selectExpr("id a", "concat('v', id) c", "id `odd name`").write.parquet(f"{tmp_path}/y")
    got = read_consistent(spark, [str(tmp_path)], {"c": "b"})
    assert got.dtypes == [("a", "bigint"), ("b", "string"), ("odd name", "bigint")]
    assert rows(got) == sorted([(i, str(i), None) for i in range(3)] + [(i, f"v{i}", i) for i in range(3)], key=repr)


def test_a_name_used_again_is_another_column(spark):
    ident = lambda n: {"parquet.field.id": n}
    df = files(
        spark,
        (None, struct(("batch", "integer", ident(3)), ("lat", "long", ident(6)), ("x", "date", ident(1)))),
        (None, struct(("batch_v2", "integer", ident(3)), ("LAT", "long", ident(6)))),
        (None, struct(("batch_v2", "integer", ident(3)), ("batch", "string", ident(18)), ("LAT", "long", ident(6)), ("lat", "double", ident(19)), ("x", "long", ident(2)))),
        (None, struct(("batch_v2", "integer", ident(3)), ("batch", "string", ident(18)), ("LAT", "long", ident(6)))),
        (None, struct(("batch_v2", "integer", ident(3)), ("batch", "string", ident(18)), ("LAT", "long", ident(6)), ("lat", "double", ident(19)))),
    )
    c = DriftCatalogue(df)
    assert rows(c.casts().select("old_name", "field_id", "first_pos", "last_pos", "name", "type")) == sorted(
        [
            ("batch", 3, 1, 1, "batch_v2", "integer"), ("batch_v2", 3, 2, 5, "batch_v2", "integer"), ("batch", 18, 3, 5, "batch", "string"),
            ("lat", 6, 1, 1, "LAT", "long"), ("LAT", 6, 2, 5, "LAT", "long"), ("lat", 19, 3, 3, "lat_2", "double"), ("lat", 19, 5, 5, "lat_2", "double"),
            ("x", 2, 3, 3, "x", "long"), ("x", 1, 1, 1, "x_2", "date"),
        ],
        key=repr,
    )
    assert ("batch", "batch_v2", 3, 1, 1) in rows(c.aliases().select("old_name", "name", "field_id", "first_pos", "last_pos"))


def test_read_consistent_loses_no_field(spark, tmp_path):
    spark.range(3).selectExpr("id a").write.parquet(f"{tmp_path}/x")
    spark.range(3).selectExpr("id a", "id + 7 b").write.parquet(f"{tmp_path}/y")
    with pytest.raises(ValueError, match="several fields for b"):
        read_consistent(spark, [str(tmp_path)], {"a": "b"})


def test_casts_inside_structs(spark):
    ident = lambda n: {"parquet.field.id": n}
    df = files(
        spark,
        (None, struct(("s", struct(("town", "long", ident(2)), ("gone", "date"), ("in", struct(("p", "integer"))))), ("o", struct(("k", "long"))))),
        (None, struct(("place", struct(("in", struct(("q'", "double"), ("p", "long"))), ("city", "string", ident(2))), {"former_name": "s"}), ("o", "string"))),
    )
    casts = {r["old_name"] + str(r["first_pos"]): r for r in DriftCatalogue(df).casts().collect()}
    assert {k: r["name"] for k, r in casts.items()} == {"s1": "place", "place2": "place", "o1": "o", "o2": "o"}
    assert casts["s1"]["type"] == casts["place2"]["type"] == "struct<gone:date,in:struct<p:long,`q'`:double>,city:string>"
    one = spark.sql("SELECT named_struct('town', 5L, 'gone', DATE '2020-01-01', 'in', named_struct('p', 3)) s, named_struct('k', 1L) o UNION ALL SELECT NULL, NULL")
    two = spark.sql("""SELECT named_struct('in', named_struct("q'", 0.5D, 'p', 4L), 'city', 'x') place, 'y' o""")
    got = one.selectExpr(casts["s1"]["cast_sql"], casts["o1"]["cast_sql"]).union(two.selectExpr(casts["place2"]["cast_sql"], casts["o2"]["cast_sql"]))
    assert got.select("place").schema["place"].dataType.simpleString() == "struct<gone:date,in:struct<p:bigint,q':double>,city:string>"
    assert rows(got.selectExpr("place.gone IS NULL", "place.in.p", "place.in.`q'`", "place.city", "o")) == sorted(
        [(False, 3, None, "5", '{"k":1}'), (True, None, None, None, None), (True, 4, 0.5, "x", "y")], key=repr
    )


def test_read_consistent_inside_structs(spark, tmp_path):
    spark.range(2).selectExpr("id", "named_struct('a', cast(id as int), 'b', 'x') s").write.parquet(f"{tmp_path}/x")
    spark.range(2).selectExpr("id", "if(id = 0, named_struct('c', id, 'a', id + 5), null) s").write.parquet(f"{tmp_path}/y")
    got = read_consistent(spark, [str(tmp_path)])
    assert dict(got.dtypes)["s"] == "struct<a:bigint,b:string,c:bigint>"
    assert rows(got.selectExpr("id", "s.a", "s.b", "s.c", "s is null")) == sorted([(0, 0, "x", None, False), (1, 1, "x", None, False), (0, 5, None, 0, False), (1, None, None, None, True)], key=repr)


def test_read_consistent_follows_fields(spark, tmp_path):
    """By id and former name, with a name used again, names swapped in one version, and digits that a double would lose."""
    import time

    told = lambda c, name, **m: c.alias(name, metadata={k.replace("__", "."): v for k, v in m.items()})
    n, big = F.col("id"), (F.col("id") + (1 << 60) + 1)
    write = lambda *columns: (spark.range(2).select(*columns).coalesce(1).write.mode("append").parquet(str(tmp_path)), time.sleep(1.1))
    write(told(n, "a", parquet__field__id=1), told(n * 10, "x", parquet__field__id=3), told(n * 100, "y", parquet__field__id=4), big.alias("big"), n.cast("int").alias("plain"))
    write(told(n + 5, "b", parquet__field__id=1), told(n * 100, "x", parquet__field__id=4), told(n * 10, "y", parquet__field__id=3), (n / 2).alias("big"))
    write(told(n + 7, "b", parquet__field__id=1), told(F.concat(F.lit("s"), n), "a", parquet__field__id=2), told(n, "renamed", former_name="plain"))
    got = read_consistent(spark, [str(tmp_path)])
    assert got.columns == ["b", "y", "x", "big", "plain", "a", "renamed"]
    assert rows(got.select("b", "a", "y", "x", "big")) == sorted(
        [(i, None, i * 10, i * 100, str(i + (1 << 60) + 1)) for i in range(2)] + [(i + 5, None, i * 10, i * 100, str(i / 2)) for i in range(2)] + [(i + 7, f"s{i}", None, None, None) for i in range(2)], key=repr
    )
    with pytest.raises(Exception, match="(?i)no parquet|path"):
        read_consistent(spark, [str(tmp_path / "none")])

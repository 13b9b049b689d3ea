import pytest

from ashlar.operators import clean
from ashlar.operators.profile import fit
from ashlar.sources.lines import as_lines, first_row, preview, read_lines

JAGGED = ["a,b", "name,size,city", "x,1,p", "name,size,city", 'y,2,"q,r"', "1,2,3,4"[:5], "z,3,"]


def lines(spark, texts, partitions=2):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, value string").repartition(partitions)


def test_shape_finds_width_header_and_jaggedness(spark):
    shape = clean.field_shape(lines(spark, JAGGED)).first()
    assert (shape.n_rows, shape.min_fields, shape.max_fields, shape.jagged) == (7, 2, 3, True)
    assert (shape.widest_row, shape.header) == (1, "name,size,city")
    flat = clean.field_shape(lines(spark, ["a,b", "c,d"])).first()
    assert not flat.jagged and flat.widest_row == 0


def test_rectangularize_with_header(spark):
    table = clean.rectangularize(lines(spark, JAGGED))
    assert table.names == ["name", "size", "city"]
    rows = [tuple(r)[1:] for r in table.rows.orderBy("row_id").collect()]
    assert rows == [("x", "1", "p"), ("y", "2", " q_r "), ("1", "2", "3"), ("z", "3", "")]
    assert [r.value for r in table.rejected.collect()] == ["a,b"]


def test_rectangularize_without_header_loses_no_row(spark):
    table = clean.rectangularize(lines(spark, ["1,2", "1,2", "3,4"]), header=False)
    assert table.names == ["c0", "c1"] and table.rows.count() == 3


def test_empty_input_is_refused(spark):
    with pytest.raises(ValueError):
        clean.rectangularize(lines(spark, ["x"]).limit(0))


def test_trailing_blanks_count_as_fields(spark):
    assert clean.field_shape(lines(spark, ["a,b,,", "c,d"])).first().max_fields == 4


def test_names_are_unique_and_never_blank():
    assert clean.unique_names(["a", "", "A", "a", " b ", "row_id"]) == ["a", "c1", "A_2", "a_3", "b", "row_id_2"]


def test_names_with_dots_survive(spark):
    table = clean.rectangularize(lines(spark, ["-1.57,0.62", "1.5,2", "2.5,4"]))
    assert table.names == ["-1.57", "0.62"]
    assert fit(table.rows, table.names)["0.62"].mean == 3.0


def test_sentinel_round_trip(spark):
    marked = clean.append_sentinel(lines(spark, ["a,b"]))
    assert marked.first().value == "a,b,No Data"
    table = clean.to_columns(marked, ["x", "y", "No Data"])
    assert clean.drop_sentinel(table).columns == ["row_id", "x", "y"]


def test_header_detection(spark):
    found = clean.detect_header(lines(spark, ["name,size", "text,unit", "x,1"])).orderBy("line").collect()
    assert [r.looks_like_header for r in found] == [True, True]
    found = clean.detect_header(lines(spark, ["x,1", "name,size"])).orderBy("line").collect()
    assert [r.looks_like_header for r in found] == [False, False]
    assert clean.detect_header(lines(spark, ["name"])).count() == 1


def test_split_fields_and_types(spark):
    table = clean.rectangularize(lines(spark, ["a,b,c", "1,2.5,x", "2,y,z"]))
    types = {s.column: s.inferred_type for s in fit(table.rows, table.names).values()}
    assert types == {"a": "Int", "b": "Double", "c": "String"}
    typed = clean.typed_columns(table.rows, table.names, types)
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "string"]
    # A text among numbers is zero and later values do not move to the left.
    assert sorted(map(tuple, clean.numbers_only(table.rows, table.names, types).collect())) == [(1, 2.5), (2, 0.0)]
    fields = clean.split_fields(lines(spark, ["a,,b"])).orderBy("col_idx").collect()
    assert [(r.col_idx, r.field) for r in fields] == [(0, "a"), (1, ""), (2, "b")]


def test_lines_keep_file_order(spark, folder):
    for part in range(3):
        with open(f"{folder}/part-{part}.txt", "w") as out:
            out.write("\n".join(f"{part},{i}" for i in range(1000 * (3 - part))) + "\n")
    found = read_lines(spark, folder)
    texts = [r.value for r in found.repartition(5).orderBy("row_id").collect()]
    assert texts == [f"{p},{i}" for p in range(3) for i in range(1000 * (3 - p))]
    assert first_row(found, "row_id").first().value == "0,0"
    assert [r.value for r in preview(found, "row_id", 3).collect()] == ["0,0", "0,1", "0,2"]


def test_rows_as_lines(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "k int, s string, d double")
    assert sorted(r.value for r in as_lines(df, "k").collect()) == ["1,a,", "2,,2.5"]

"""The three programs end to end, over files."""

import os

import pytest

from ashlar.plans.anonymizer import make_substitute
from ashlar.plans.datamaker import make_data
from ashlar.plans.features import find_features
from ashlar.sources.lines import numbered_lines
from ashlar.sources.sinks import label_path, read_back, read_table_back, write_csv

MEANS, VARIANCES = [1.2, 3.4, 5.6], [7.8, 9.10, 11.12]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("made") / "rows.csv")
    return path, make_data(spark, path, 3000, 3, MEANS, VARIANCES, seed=4, partitions=3)


def test_data_maker(spark, made):
    _, results = made
    assert results["preview"].count() == 5
    for r in results["check"].collect():
        assert r["count"] == 3000 and abs(r.mean_error) < 4


def test_feature_finder(spark, made, folder):
    path, _ = made
    out = f"{folder}/normalized.csv"
    results = find_features(spark, path, out, folder, header=False)
    assert results["rows"].count() == 3000 and results["rejected"].count() == 0
    types = [r.inferred_type for r in results["profile"].orderBy("col_idx").collect()]
    assert types == ["String", "Double"] * 3
    for r in results["normality"].collect():
        assert r.p_value > 0.001
    assert results["correlated_pairs"].count() == 0
    assert {r["count"] for r in results["histogram"].groupBy("column").sum("count").toDF("column", "count").collect()} == {3000}
    assert results["extreme_rows"].count() == 50
    for name in ("independence", "goodness_of_fit", "density", "median", "mode", "ranked_modes", "hits"):
        results[name].collect()
    again = read_back(spark, out)
    assert again.rows.count() == 3000
    from ashlar.operators.profile import fit

    for s in fit(again.rows, again.names).values():
        if s.inferred_type == "Double":
            assert s.mean == pytest.approx(0, abs=1e-9) and s.variance == pytest.approx(1, abs=1e-9)
    norms = read_back(spark, label_path(path, folder))
    assert norms.names[-2:] == ["L1-Norm", "L2-Norm"] and norms.rows.count() == 3000


def test_header_of_headerless_data_costs_one_row(spark, made):
    path, _ = made
    assert find_features(spark, path)["rows"].count() == 2999


def test_anonymizer(spark, made, folder):
    path, _ = made
    results = make_substitute(spark, path, f"{folder}/substitute.csv", header=False, seed=9)
    rows = results["fidelity"].collect()
    assert len(rows) == 6
    for r in rows:
        if r.variance_before:
            assert abs(r.mean_delta) < 6 * (r.variance_before / 3000) ** 0.5
            assert r.variance_after == pytest.approx(r.variance_before, rel=0.2)
    assert results["substituted"].count() == 3000


def test_substitute_does_not_depend_on_packing(spark, made, folder):
    path, _ = made
    found = []
    for i, (source, size) in enumerate([(path, "128m"), (path, "20k"), (path, "7k")]):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            make_substitute(spark, source, f"{folder}/out{i}", header=False, seed=3)
            lines = [r.value.split(",") for r in spark.read.text(f"{folder}/out{i}").collect()]
            # Means come from sums, whose last digits follow the order of adding.
            found.append(sorted(tuple(f"{float(x):.9g}" if x[-1:].isdigit() and "." in x else x for x in line) for line in lines))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2] and len(found[0]) == 3000


def test_line_numbers(spark, folder):
    for part in "ab":
        os.makedirs(f"{folder}/{part}")
        with open(f"{folder}/{part}/lines.txt", "w") as out:
            out.write("".join(f"line {i}\n" for i in range(700)))
    for part, size in (("a", "128m"), ("b", "1k"), ("a", "3k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = numbered_lines(spark, f"{folder}/{part}").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r.row_id.file, r.row_id.line, r.value) for r in rows) == [("lines.txt", i, f"line {i}") for i in range(700)]


def test_quotes_jagged_rows_and_repeated_headers(spark, folder):
    path = f"{folder}/messy.csv"
    with open(path, "w") as out:
        out.write('id,who,size\n1,"Lee, Ann",2.5\nbroken\n2,Bo,3\nid,who,size\n3,Cy,4.5\n4,Di,x\n')
    results = find_features(spark, path, ids=["id"])
    assert results["rows"].count() == 4
    assert [r.value for r in results["rejected"].collect()] == ["broken"]
    stats = {r["column"]: r for r in results["profile"].collect()}
    assert stats["who"].inferred_type == "String"
    assert (stats["size"].inferred_type, stats["size"].mean, stats["size"].parsed) == ("Double", 2.5, 3)
    assert results["labeled_norms"].columns == ["id", "l1_norm", "l2_norm"]


def test_label_path():
    assert label_path("/data/in/rows.csv", "/out") == "/out/rowsLabel.csv"


def test_a_header_is_detected(spark, made, folder):
    path, _ = made
    assert find_features(spark, path, header=None)["rows"].count() == 3000
    headed = f"{folder}/headed.csv"
    with open(headed, "w") as out:
        out.write("who,size\nAnn,2.5\nBo,3\n")
    results = find_features(spark, headed, header=None, ids=["who"])
    assert results["rows"].count() == 2
    assert [r["column"] for r in results["profile"].orderBy("col_idx").collect()] == ["who", "size"]
    make_substitute(spark, headed, f"{folder}/substitute", header=None)
    again = read_back(spark, f"{folder}/substitute")
    assert again.names == ["who", "size"] and again.rows.count() == 2


def test_medians_of_the_program_are_those_of_its_scan(spark, made):
    path, _ = made
    results = find_features(spark, path, header=False, low=-2.0, high=2.0)
    medians = {r["column"]: r["median"] for r in results["median"].collect()}
    stats = {r["column"]: r for r in results["profile"].collect()}
    hits = results["hits"].collect()
    assert hits
    for r in hits:
        assert r.low == pytest.approx(medians[r["column"]] - 2 * stats[r["column"]].stddev, rel=1e-12)
        assert r.value < r.low or r.value > r.high


def test_numbers_are_staged_as_numbers(spark, made, folder):
    path, _ = made
    with find_features(spark, path, header=False, low=-2.0, high=2.0) as results:
        plan = results["hits"]._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [Or(" in plan and "try_cast" not in plan and "RLIKE" not in plan
        # Texts stay as they were wherever they are shown.
        first = min(results["rows"].collect(), key=lambda r: r.row_id)
        shown = {tuple(r)[:6] for r in results["labeled_norms"].collect()}
        assert tuple(first)[1:7] in shown
        counts = results["hits"].count()
        staged = results.staged.path.removeprefix("file://")
        assert os.path.isdir(staged)
    assert not os.path.exists(staged)
    unstaged = find_features(spark, path, header=False, low=-2.0, high=2.0, stage=False)
    assert unstaged["hits"].count() == counts
    unstaged.close()


def test_labels_and_leading_numbers_are_shown_as_written(spark, folder):
    path, out = f"{folder}/labels.csv", f"{folder}/out"
    with open(path, "w") as lines:
        lines.write("id,size,who\n" + "".join(f"0{20000 + i},{i}.50,w{i}\n" for i in range(40)))
    results = find_features(spark, path, out, folder)
    written = [r.value.split(",") for r in spark.read.text(out).collect() if not r.value.startswith("id,")]
    assert sorted(w[0] for w in written) == [f"0{20000 + i}" for i in range(40)]
    assert sorted(r.size for r in results["labeled_norms"].collect()) == sorted(f"{i}.50" for i in range(40))
    results.close()


def test_written_texts_come_back_as_they_were(spark, folder):
    texts = [
        "plain", "", None, " blanks ", "a,b", "two\nlines", "crlf\r\nand\rcr", '"quoted"', 'say "x", then\n"y"', "back\\slash\\\"",
        "text", '"', '""', "\n", ",", "tab\t", "Ünï 中文 🎉", "'single'", "#no comment",
    ]
    df = spark.createDataFrame([(i, t, "text") for i, t in enumerate(texts)], "id long, text string, other string").repartition(3)
    # A row equal to the header is a row.
    df = df.union(spark.createDataFrame([(None, "text", "other")], df.schema))
    write_csv(df, f"{folder}/exact", exact=True)
    again = read_table_back(spark, f"{folder}/exact", df.schema)
    assert sorted(again.collect(), key=repr) == sorted(df.collect(), key=repr)


def test_documents_come_back_whole(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    write_csv(docs.repartition(4), f"{folder}/docs", exact=True)
    again = read_table_back(spark, f"{folder}/docs", docs.schema)
    assert sorted(again.collect()) == sorted(docs.collect())

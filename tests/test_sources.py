"""Files in the text layouts, and the parse and clean rules."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as P
from graphloom.sources import files, readers, writers


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines))


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "token, want",
    [
        ("abc", None), ("", None), ("1d", None), ("2f", None), ("0x1p3", None), ("1_0", 10.0), ("_1", None), ("1__0", None),
        (" 2 ", 2.0), ("-3", -3.0), ("1e9", 1e9), (".5", 0.5), ("5.", 5.0), ("inf", math.inf), ("-Infinity", -math.inf),
    ],
)
def test_parse_float(spark, token, want):
    assert one(spark, token, P.parse_float) == want


def test_parse_nan(spark):
    assert math.isnan(one(spark, "NaN", P.parse_float))


@pytest.mark.parametrize("token, want", [("-3", 0.0), ("1e9", 0.0), ("inf", 0.0), ("-inf", 0.0), ("x", 0.0), ("7.5", 7.5), ("100000000", 1e8)])
def test_clean_dense(spark, token, want):
    assert one(spark, token, lambda c: P.clean_dense_feature(F.array(c)))[0] == want


def test_nan_is_kept_unless_asked(spark):
    assert math.isnan(one(spark, "nan", lambda c: P.clean_dense_feature(F.array(c)))[0])
    assert one(spark, "nan", lambda c: P.clean_dense_feature(F.array(c), nan="zero"))[0] == 0.0


@pytest.mark.parametrize(
    "token, want",
    [("1:0.5", (0, 0.5)), ("x:1", None), ("3:", (2, 0.0)), ("3", (2, 0.0)), ("2:20000", (1, math.log(20000))), ("2:-5", (1, -5.0)), ("1.5:2", None)],
)
def test_clean_sparse(spark, token, want):
    got = one(spark, token, P.clean_sparse_token)
    assert (got and (got["idx"], pytest.approx(got["val"]))) == want


def test_subgraph_files_named_by_index(spark, tmp_path, rows):
    for i in range(3):
        write(tmp_path / "nodes" / str(i), [f"p\tn{i}{j}\t{j}\t-1\tbad\t{j % 2}" for j in range(2)])
        write(tmp_path / "edges" / str(i), [f"a\tb\tn{i}0\tn{i}1\t{i}.5"])
    nodes = readers.read_subgraph_nodes(spark, str(tmp_path / "nodes"))
    assert rows(nodes, "subgraph_id", "id", "label")[:2] == [(0, "n00", "0"), (0, "n01", "1")]
    assert nodes.filter("id = 'n21'").first()["features"] == [1.0, 0.0, 0.0]
    edges = readers.read_subgraph_edges(spark, str(tmp_path / "edges"))
    assert rows(edges) == [(i, f"n{i}0", f"n{i}1", i + 0.5) for i in range(3)]


def test_libsvm_file(spark, tmp_path, rows):
    write(tmp_path / "0", ["p\tn0\t1:0.5\tx:1\t3:\t2:20000\t1:0.5", "p\tn1"])
    nodes = readers.read_libsvm_nodes(spark, str(tmp_path), n_features=4)
    assert rows(readers.sparse_cells(nodes), "id", "idx", "val") == [("n0", 0, 1.0), ("n0", 1, math.log(20000)), ("n0", 2, 0.0)]
    dense = dict(rows(readers.sparse_to_dense(nodes, 4), "id", "features"))
    assert dense["n0"] == [1.0, math.log(20000), 0.0, 0.0] and dense["n1"] == [0.0] * 4


def test_feature_index_out_of_range_is_an_error(spark, tmp_path):
    write(tmp_path / "0", ["p\tn0\t9:1"])
    with pytest.raises(Exception, match="outside"):
        readers.read_libsvm_nodes(spark, str(tmp_path), n_features=4).collect()


def test_bad_edge_line_is_an_error(spark, tmp_path):
    write(tmp_path / "e", ["1 2 x"])
    with pytest.raises(Exception):
        readers.read_edge_list(spark, str(tmp_path / "e"), 0, 1, 2).collect()


def test_word2vec_and_embeddings_round_trip(spark, tmp_path, rows):
    write(tmp_path / "w2v", ["2 3", "1 0.5 1 2", "2 3 4 5"])
    assert rows(readers.read_word2vec_text(spark, str(tmp_path / "w2v"))) == [(0, [0.5, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]
    emb = spark.createDataFrame([(0, "a", [1.5, 2.0]), (3, "b", [0.25, -1.0])], "subgraph_id int, id string, vec array<float>")
    for sep in ("\x01", "\t"):
        out = str(tmp_path / f"emb{ord(sep)}")
        writers.write_embeddings(emb, out, sep)
        assert sorted(os.listdir(out))[-2:] == ["subgraph_id=0", "subgraph_id=3"]
        assert rows(readers.read_embeddings(spark, out, sep), "subgraph_id", "id", "vec") == [(0, "a", [1.5, 2.0]), (3, "b", [0.25, -1.0])]


def test_materialize_subgraphs(spark, tmp_path, rows):
    parts = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, part int")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, w double")
    nodes, inside = writers.materialize_subgraphs(parts, edges, parts.select("id"), str(tmp_path / "sub"))
    assert rows(nodes, "id", "subgraph_id") == [(1, 0), (2, 0), (3, 1)]
    assert rows(inside, "subgraph_id", "src", "dst") == [(0, 1, 2)]


def test_composite_keys_survive_augmentation(spark, tmp_path, rows):
    write(tmp_path / "0", ["a\tb\tx\t1\ty\t2\t3.0"])
    edges = readers.read_composite_edges(spark, str(tmp_path)).withColumns({"c0": F.lit("a"), "c1": F.lit("b")})
    assert rows(edges, "src", "dst") == [("x\t1", "y\t2")]
    added = edges.select("subgraph_id", "c0", "c1", F.col("dst").alias("src"), F.col("src").alias("dst"))
    writers.write_augmented_edges(edges, added, str(tmp_path / "out"))
    assert rows(readers.read_composite_edges(spark, str(tmp_path / "out")), "src", "intimacy") == [("x\t1", 3.0), ("y\t2", 1.0)]


def test_recent_files(spark, tmp_path):
    for i, (size, age) in enumerate([(100, 10), (200, 20), (300, 30), (50, 1)]):
        p = tmp_path / f"f{i}"
        p.write_bytes(b"x" * size)
        stamp = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc).timestamp() - age * 86400
        os.utime(p, (stamp, stamp))
    sub = tmp_path / "folder"
    write(sub / "inside", ["x"])
    before = dt.datetime(2024, 1, 30, tzinfo=dt.timezone.utc)  # f3 is newer
    pattern = f"{tmp_path}/*"
    names = [p.rsplit("/", 1)[1] for p in files.select_recent_files(spark, pattern, 250, before).split(",")]
    assert names == ["f0", "f1"]
    assert files.select_recent_files(spark, pattern, 250, dt.datetime(2000, 1, 1)) == ""


def test_score_rows_with_date(spark, tmp_path):
    scores = spark.createDataFrame([("20210103", "o1", "r1", -0.5)], "dt string, account string, role string, p double")
    writers.write_scores(scores, str(tmp_path / "s"), ("dt", "account", "role", "p"), "\x01")
    assert spark.read.text(str(tmp_path / "s")).first()[0] == "20210103\x01o1\x01r1\x01-0.5"


def test_bare_scans_are_not_copied(spark):
    from graphloom.scratch import is_scan, settled

    nation = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    assert is_scan(nation) and is_scan(nation.select("n_name", "n_nationkey")) and settled(nation) is nation
    assert not is_scan(nation.filter("n_nationkey > 3")) and not is_scan(nation.select((nation.n_nationkey + 1).alias("x")))
    assert not is_scan(nation.groupBy("n_name").count()) and not is_scan(nation.limit(3))

import json

import pytest
from pyspark.sql import functions as F

from millrace import cache, cli
from millrace.operators import pool as P
from millrace.sources import readers, writers
from millrace.streaming import events as E


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_features_txt_round_trip(spark, tmp_path):
    path = put(tmp_path, "f.txt", "q1\t1.5\tu1\t0\t0.25\t-2\nq2\t0\tu2\t1\t3\t4\n")
    df = readers.read(spark, path)
    rows = df.orderBy("row_id").collect()
    assert [(r.query_id, r.target, r.item_id, r.features) for r in rows] == [("q1", 1.5, "u1@q1", [0.25, -2.0]), ("q2", 0.0, "u2@q2", [3.0, 4.0])]
    writers.features_txt(df, str(tmp_path / "out"), url="url", group="group_id")
    again = readers.features_txt(spark, str(tmp_path / "out")).orderBy("target").collect()
    assert [r.features for r in again] == [[3.0, 4.0], [0.25, -2.0]]
    bad = put(tmp_path, "bad.txt", "q\t1\tu\t0\t1\t2\nq\t1\tu\t0\t1\n")
    with pytest.raises(Exception, match="width"):
        readers.features_txt(spark, bad).collect()


def test_letor(spark, tmp_path):
    path = put(tmp_path, "l.txt", "2 qid:10 1:0.5 2:0.25 #docid = GX-1 inc = 1\n0 qid:11 1:0 2:1 #docid = GX-2\n")
    rows = readers.letor(spark, path).orderBy("row_id").collect()
    assert [(r.target, r.group_id, r.item_id, r.features) for r in rows] == [(2.0, "10", "GX-1", [0.5, 0.25]), (0.0, "11", "GX-2", [0.0, 1.0])]


def test_libsvm_round_trip(spark, tmp_path):
    path = put(tmp_path, "s.txt", "1 0:0.5  3:2\n-1 1:1\n")
    df = readers.libsvm(spark, path)
    dense = df.select("row_id", "target", readers.dense(F.col("features"), 4).alias("features"))
    assert [r.features for r in dense.orderBy("row_id").collect()] == [[0.5, 0, 0, 2.0], [0, 1.0, 0, 0]]
    writers.libsvm(dense, str(tmp_path / "out"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["-1\t1:1", "1\t0:0.5\t3:2"]


def test_extreme(spark, tmp_path):
    path = put(tmp_path, "x.txt", "3 5 4\n0,2 1:1.5 3:2\n1:0.5\n3 0:1\n")
    rows = readers.extreme(spark, path).orderBy("row_id").collect()
    assert [(r.labels, r.features) for r in rows] == [([0, 2], {1: 1.5, 3: 2.0}), ([], {1: 0.5}), ([3], {0: 1.0})]


def test_catboost(spark, tmp_path):
    path = put(tmp_path, "c.tsv", "1\t0.5\tred\t2\n0\t1.5\tblue\t1\n")
    cd = put(tmp_path, "c.cd", "0\tTarget\n2\tCateg\tcolour\n3\tWeight\n")
    rows = readers.catboost(spark, path, cd).orderBy("row_id").collect()

    def java(s):
        h = 0
        for c in s:
            h = (31 * h + ord(c)) & 0xFFFFFFFF
        return (h - (1 << 32) if h >= 1 << 31 else h) / 2**32

    assert [(r.target, r.weight, r.features) for r in rows] == [(1.0, 2.0, [0.5, java("red")]), (0.0, 1.0, [1.5, java("blue")])]
    assert readers.column_description("", 2) == [("Target", ""), ("Num", "")]
    for bad in ("0\tNum\n", "0\tTarget\n1\tTarget\n", "0\tTarget\n1\tWhat\n", "0\tTarget\n1\tAuxiliary\n"):
        with pytest.raises(ValueError):
            readers.column_description(bad, 2)


def test_json_pool_round_trip(spark, tmp_path):
    text = 'items\t{id: "p", type: "FAKE"}\t["a","b"]\nfeature\t{id: "f0", description: "first", type: "VEC"}\t[1.5,2.5]\ntarget\t{id: "y", type: "INTS"}\t[1,0]\n'
    df = readers.json_pool(spark, put(tmp_path, "p.json", text))
    assert [(r.item, r.f0, r.y) for r in df.orderBy("row_id").collect()] == [("a", 1.5, 1), ("b", 2.5, 0)]
    assert df.schema["f0"].metadata["description"] == "first" and P.roles(df, "target") == ["y"]
    writers.json_pool(df, str(tmp_path / "out"), "item", ["f0"], ["y"])
    again = readers.json_pool(spark, str(tmp_path / "out"))
    assert [(r.item, r.f0, r.y) for r in again.orderBy("row_id").collect()] == [("a", 1.5, 1), ("b", 2.5, 0)]


def test_logs(spark, tmp_path):
    plain = put(tmp_path, "e.tsv", "u1\ti1\t1.0\nbroken\nu1\ti1\t2.5\nu2\ti1\t0.5\nu1\ti2\tx\n")
    rows = readers.event_log(spark, plain).orderBy("ts").collect()
    assert [(r.user, r.user_id, r.delta) for r in rows] == [("u2", 0, None), ("u1", 1, None), ("u1", 1, 1.5)]
    fm = put(tmp_path, "fm.tsv", "u\t2009-05-04T01:00:00Z\t-\tsong\nu\tbad\t-\tsong\n")
    assert readers.event_log(spark, fm, "lastfm").count() == 1
    session = {"uid": "u", "timestamp": 1, "reqid": "r", "user_region": 2, "query": "q", "sntypes": ["w", "i"], "rel": ["good", "bad"], "clicks": [1], "clicks_dwelltime": [5]}
    clicks = readers.click_log(spark, put(tmp_path, "k.json", json.dumps(session) + "\n")).orderBy("position").collect()
    assert [(r.type, r.grade, r.clicked) for r in clicks] == [("w", "good", False), ("i", "bad", True)]
    import zipfile

    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("session1.txt", "1 2\n3 4\n")
        z.writestr("other.txt", "9\n")
    steps = readers.session_archive(spark, str(tmp_path / "s.zip")).orderBy("step").collect()
    assert [(r.step, r.features, r.target) for r in steps] == [(0, [1.0, 2.0], 0.0), (1, [3.0, 4.0], 1.0)]
    with pytest.raises(KeyError):
        readers.read(spark, plain, "no")
    assert readers.columns_in_first_line(spark, plain) == 3
    csv = put(tmp_path, "d.csv", "a,b\n1,\n,2\n")
    assert readers.delimited(spark, csv, "a int, b int", {"b": -1}, F.col("a").isNotNull()).collect() == [(1, -1)]


def test_command_line(spark, tmp_path, capsys):
    lines = "\n".join(f"q\t{2 * (i % 7 > 3) + 0.1 * (i % 3)}\tu{i}\t0\t{i % 7}\t{i % 3}" for i in range(60))
    pool, out = put(tmp_path, "p.txt", lines + "\n"), str(tmp_path / "m")
    small = "GradientBoosting(weak=GreedyObliviousTree(depth=2, loss=L2), iterations=3, step=0.5)"
    result = cli.main(["fit", "-f", pool, "-O", small, "-o", out], spark)
    assert result["learn"]["L2"] < 0.6
    assert cli.main(["evaluate-model", "-f", pool, "-m", f"{out}.model"], spark)["L2"] == pytest.approx(result["learn"]["L2"])
    assert cli.main(["apply", "-f", pool, "-m", f"{out}.model", "-o", out], spark)["rows"] == 60
    assert spark.read.text(f"{out}.values").count() == 60
    assert cli.main(["validate-model", "-m", f"{out}.model"], spark)["valid"]
    assert len(cli.main(["interpret-model", "-f", pool, "-m", f"{out}.model", "--top", "2"], spark)["rules"]) <= 2
    assert cli.main(["validate-pool", "-f", pool], spark)["problems"] == []
    assert cli.main(["print-pool-info", "-f", pool], spark)["columns"]
    cli.main(["split-json-pool", "-f", pool, "-X", "0.5", "-o", out], spark)
    assert spark.read.parquet(f"{out}.learn").count() + spark.read.parquet(f"{out}.test").count() == 60
    cli.main(["convert-pool-libsvm", "-f", pool, "-o", f"{out}.svm"], spark)
    cli.main(["convert-pool-features", "-f", pool, "-o", f"{out}.txt"], spark)
    schemes = cli.main(["cross-validation", "-f", pool, "-O", "RidgeRegression()|WeakLeastAngle()", "-k", "2"], spark)["schemes"]
    assert len(schemes) == 2
    best = cli.main(["grid-search", "-f", pool, "-O", "RidgeRegression(alpha={a})", "-r", "a=0.1,10"], spark)
    assert best["L2"][1]["a"] in (0.1, 10.0)


def test_catalog_follows_dependencies(spark, tmp_path):
    made = []
    c = cache.Catalog(spark, str(tmp_path / "cat"))
    c.add("a", lambda s, _: made.append("a") or s.range(3))
    c.add("b", lambda s, k: made.append("b") or k.get("a").selectExpr("id * 2 as id"))
    assert sorted(r.id for r in c.get("b").collect()) == [0, 2, 4] and made == ["b", "a"]
    assert c.get("b").count() == 3 and made == ["b", "a"]
    c.touch("a")
    assert c.stale("b")
    c.get("b")
    assert made == ["b", "a", "b"]
    c.add("x", lambda s, k: k.get("x"))
    with pytest.raises(ValueError):
        c.get("x")


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"u": 1, "i": "a", "ts": "2024-01-01T00:00:00Z", "h": 0.0}, {"u": 1, "i": "b", "ts": "2024-01-01T00:10:00Z", "h": 0.17},
            {"u": 1, "i": "a", "ts": "2024-01-01T05:00:00Z", "h": 5.0}, {"u": 2, "i": "a", "ts": "2024-01-01T09:00:00Z", "h": 9.0}]
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows) + "\nbroken\n")
    stream = E.json_lines(spark, str(folder), "u int, i string, ts timestamp, h double")
    found = _run(E.sessions(stream, "u", "ts"), "s1").collect()
    assert [(r.u, r.n_events) for r in found] == [(1, 2), (1, 1)] or sorted((r.u, r.n_events) for r in found) == [(1, 1), (1, 2)]
    seen = _run(E.online_intensity(stream, "u", "i", "ts", "h", lambda u, i: 1.0, base=0.5, decay=0.1), "s2").orderBy("h").collect()
    import math

    assert [round(r.intensity, 6) for r in seen] == [1.5, round(1.5 + math.exp(-0.1), 6), round(0.5 + 1 + math.exp(-0.1) * (1 + math.exp(-0.1)), 6), 1.5]
    counts = []
    q = E.listen(stream, lambda df, n: counts.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sum(counts) == 4
    p = spark.range(1).select(E.interval_probability(F.lit(1.0), F.lit(0.0), F.lit(1e9)).alias("a"), E.gamma_interval_probability(F.lit(1.0), F.lit(0.0), F.lit(1e3)).alias("b")).first()
    assert p.a == pytest.approx(1.0) and p.b == pytest.approx(1.0)
    days = E.next_day(spark.createDataFrame([(1, 48.0), (1, 50.0), (2, 5.0)], "u int, d double"), "u", "d")
    assert {r.u: (r.days, r.hour_gap) for r in days.collect()} == {1: (2.0, 5.0), 2: (0.0, 5.0)}

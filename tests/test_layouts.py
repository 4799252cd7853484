"""CSV tables whose columns changed: every part is read by the columns it was written with."""

from barflow import schemas
from barflow.sources import layouts, logs, sinks

OLD = ["Ts", "Fiyat", "AI_Skor", "Filtre_Skor"]
NEW = ["Ts", "Fiyat", "Sym_ADX", "BTC_ADX", "AI_Skor", "Filtre_Skor"]


def frame(spark, columns, *rows):
    return spark.createDataFrame(rows, schemas.text_schema(columns))


def test_older_parts_keep_their_columns(spark, tmp_path):
    path = f"{tmp_path}/shadow"
    sinks.append_csv(frame(spark, OLD, ("1", "10", "0.7", "0.2")), path, OLD)
    sinks.append_csv(frame(spark, NEW, ("2", "20", "31", "32", "0.8", "0.3")), path, NEW)
    sinks.append_csv(frame(spark, OLD, ("3", "30", "0.9", "0.4")), path, OLD)  # an old writer still runs
    rows = {r.ts_ms: r for r in logs.read_shadow(spark, path).collect()}
    assert [(r.price, r.sym_adx, r.btc_adx, r.ai_score, r.risk_score) for _, r in sorted(rows.items())] == [
        (10, None, None, 0.7, 0.2), (20, 31, 32, 0.8, 0.3), (30, None, None, 0.9, 0.4)]
    assert [x.names for x in layouts.history(spark, path)] == [OLD, NEW]


def test_a_renamed_column_keeps_its_values_and_a_new_one_of_its_name_does_not(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.append_csv(frame(spark, ["a", "b"], ("1", "2")), path, ["a", "b"])
    sinks.append_csv(frame(spark, ["x", "b"], ("3", "4")), path, ["x", "b"], renamed={"x": "a"})
    sinks.append_csv(frame(spark, ["b", "a", "x"], ("5", "6", "7")), path, ["b", "a", "x"])
    df = logs.read_text_table(spark, [path], ["a", "b", "x", "none"], header=True)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted([
        (None, "2", "1", None), (None, "4", "3", None), ("6", "5", "7", None)], key=repr)


def test_column_ids():
    first = layouts.Layout(0, (("a", "a"), ("b", "b")))
    second = layouts.Layout(1, (("x", "a"), ("b", "b")))
    assert layouts.column_ids([], ["a", "b"], {}) == ["a", "b"]
    assert layouts.column_ids([first], ["x", "b"], {"x": "a"}) == ["a", "b"]
    assert layouts.column_ids([first], ["b", "a"], {"b": "a", "a": "b"}) == ["a", "b"]
    assert layouts.column_ids([first, second], ["a", "x"], {}) == ["a#2", "a"]
    third = layouts.Layout(2, (("b", "b"),))
    assert layouts.column_ids([first, third], ["a", "b"], {}) == ["a", "b"]  # dropped, then back


def test_files_of_others_are_read_by_their_headers(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one.csv").write_text("Ts,Fiyat,AI_Skor\n1,10,0.5\n2,20,\n")
    (tmp_path / "log" / "two.csv").write_text('Ts,"Fiyat",Sym_ADX,AI_Skor,other\n3,30,7,0.25,x\n')
    (tmp_path / "log" / "none.csv").write_text("")
    df = logs.read_text_table(spark, [str(tmp_path / "log")], ["Ts", "Fiyat", "Sym_ADX", "AI_Skor"], header=True)
    assert sorted(tuple(r) for r in df.collect()) == [
        ("1", "10", None, "0.5"), ("2", "20", None, None), ("3", "30", "7", "0.25")]
    assert logs.read_text_table(spark, [str(tmp_path / "missing")], ["Ts"], header=True) is None


def test_no_file_is_read_for_its_columns(spark, tmp_path):
    path = f"{tmp_path}/shadow"
    for _ in range(3):
        sinks.append_csv(frame(spark, OLD, ("1", "10", "0.7", "0.2")), path, OLD)
    df = logs.read_text_table(spark, [path], OLD, header=True).select("Fiyat")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "ReadSchema: struct<Fiyat:string>" in plan

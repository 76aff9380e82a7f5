"""File sources, answer cache, streams and sinks on small files."""

import json

import pytest
from massline.plans import sinks
from massline.sources import responses, textgrid, tokfile, transcript
from massline.streaming import draws


def test_token_file(spark, tmp_path):
    row = lambda i, t, m="_": "\t".join([i, t, *"_" * 7, m])
    (tmp_path / "a.tok").write_text("\n".join(["# newdoc_id = D_news_1", row("1-2", "What'd"), row("1", "What", "BeginSeg=Yes|X=1"), row("2", "'d"), "", row("3", "you", "Seg=BeginSeg=Yes"), "# newdoc_id = D_chat_2", row("1", "Hi", "BeginSeg=Yes"), ""]))
    got = sorted(map(tuple, tokfile.read(spark, str(tmp_path)).collect()))
    assert got == [("D_chat_2", 1, "Hi", True), ("D_news_1", 1, "What", True), ("D_news_1", 2, "'d", False), ("D_news_1", 3, "you", False)]


def test_transcript(spark, tmp_path):
    text = ["1.00\t2.00\tJOE:\tHello there.", "2.00\t3.00\t\tgoes &", "3.00\t4.00\tANN:\tyes", "4.00\t5.00\tJOE:\t& on", "5.00\t6.00\t>ENV:\t((DOOR))", "6.00\t7.00\t\tstill out", "7.00\t8.00\tJOE:\ta\tb", "8.0\t9.0\tJOE:\tfused \\ x", "", "9.0 10.0 ANN: no tabs", "10.0\t11.0\tANN:\tlost &"]
    (tmp_path / "x.trn").write_text("\n".join(text))
    units, out = transcript.read(spark, str(tmp_path))
    assert [(u.unit, u.speaker, u.start, u.end, u.text, u.merged_from) for u in units.orderBy("unit").collect()] == [(1, "JOE", 1.0, 2.0, "Hello there.", 1), (2, "JOE", 2.0, 5.0, "goes on", 2), (3, "ANN", 3.0, 4.0, "yes", 1), (4, "ANN", 9.0, 10.0, "no tabs", 1)]
    assert {r.no: r.reason for r in out.collect()} == {5: "non_participant_speaker", 6: "non_participant_speaker", 7: "ambiguous_fields", 8: "backslash_fused", 11: "unanswered_fragment"}


def test_transcript_bytes_and_named_lines(spark, tmp_path):
    text = "1.0\t2.0\tJOE:\tcaf\xe9 it\x92s \x00here &\r\n2.0\t3.0\tANN:\t& and done\r3.0\t4.0\t\tin spite\tof\x7f this\n4.0\t5.0\tANN:\tnext"
    (tmp_path / "A.trn").write_bytes(text.encode("latin-1"))
    (tmp_path / "B.trn").write_bytes("1.0\t2.0\tÉVA:\té".encode())
    units, out = transcript.read(spark, str(tmp_path), {"A": "cp1252"}, apart=[("A", 1), ("A", 2)], speakerless=[("A", 3)])
    assert [(u.speaker, u.text) for u in units.where("file like '%A.trn'").orderBy("unit").collect()] == [("JOE", "café it's here"), ("ANN", "and done"), ("ANN", "in spite of this"), ("ANN", "next")]
    assert out.where("file like '%A.trn'").count() == 0
    _, strays = transcript.lines(spark, str(tmp_path), {"A": "cp1252"})
    assert sorted((r.doc, r.no, r.byte) for r in strays.collect()) == [("A", 1, "NUL"), ("A", 2, "DEL")]
    with pytest.raises(Exception, match="A.trn"):
        transcript.lines(spark, str(tmp_path))[0].collect()


def test_token_file_over_many_blocks(spark, tmp_path):
    rows = []
    for d in range(6):
        rows += [f"# newdoc_id = D_x_{d}", *["\t".join([str(i), f"w{d}.{i}", *"_" * 7, "BeginSeg=Yes" if i % 5 == 1 else "_"]) for i in range(1, 400)]]
    (tmp_path / "big.tok").write_text("\n".join(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tokfile.read(spark, str(tmp_path)).collect()
        assert tokfile.lines(spark, str(tmp_path)).select("block").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.doc_id, r.pos, r.token, r.is_start) for r in got) == sorted((f"D_x_{d}", i, f"w{d}.{i}", i % 5 == 1) for d in range(6) for i in range(1, 400))


def test_usage_and_tables(spark, tmp_path):
    (tmp_path / "D1_A_w3_sample0.usage.json").write_text('{"input_tokens": 12, "output_tokens": 3, "kind": "standard"}')
    (tmp_path / "D1_A_w3_sample0.txt").write_text("[1]")
    r = responses.usage(spark, str(tmp_path)).collect()
    assert [(x.doc_id, x.condition, x.win, x.sample, x.usage) for x in r] == [("D1", "A", 3, 0, {"input_tokens": 12, "output_tokens": 3})]
    (tmp_path / "t.csv").write_text('file,f1,reason\nA,0.5000,"one, ""two"""\nB,,\n')
    assert [tuple(x) for x in responses.table(spark, str(tmp_path / "t.csv")).collect()] == [("A", "0.5000", 'one, "two"'), ("B", None, None)]


LONG = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0 \nxmax = 2.5 \ntiers? <exists> \nsize = 2 \nitem []: \n    item [1]:\n        class = "IntervalTier" \n        name = "words" \n        xmin = 0 \n        xmax = 2.5 \n        intervals: size = 2 \n        intervals [1]:\n            xmin = 0 \n            xmax = 1.25 \n            text = "say ""hi""" \n        intervals [2]:\n            xmin = 1.25 \n            xmax = 2.5 \n            text = "" \n    item [2]:\n        class = "TextTier" \n        name = "marks" \n        xmin = 0 \n        xmax = 2.5 \n        points: size = 1 \n        points [1]:\n            number = 1.5 \n            mark = "é" \n'
SHORT = '"ooTextFile"\n"TextGrid"\n0\n2.5\n<exists>\n1\n"IntervalTier"\n"words"\n0\n2.5\n1\n0\n2.5\n"a"\n'


EMPTY = '"ooTextFile short"\n"TextGrid"\n0\n5.\n<exists>\n2\n"IntervalTier"\n"none"\n.5\n5.\n0\n"TextTier"\n"x [2] 3"\n0\n1e1\n1\n-.25\n"a ""3"" [4]"\n'


def test_textgrid(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"long": LONG.encode(), "sub/wide": LONG.encode("utf-16"), "short": SHORT.replace("\n", "\r\n").encode(), "old": EMPTY.encode("utf-8-sig"), "cut": SHORT[:-5].encode(), "more": (SHORT + '"x"').encode()}
    files |= {"odd": b"\xff\x41", "mark": b"\xef\xbb\xbf\xe9", "bare": SHORT.encode("utf-16-be"), "other": SHORT.replace("ooTextFile", "ooTextFile longer").encode(), "tierless": SHORT.split("<exists>")[0].encode() + b"<absent>\n"}
    files |= {"class": SHORT.replace("IntervalTier", "PitchTier").encode()}
    for name, raw in files.items():
        (tmp_path / f"{name}.TextGrid").write_bytes(raw)
    df = textgrid.read(spark, str(tmp_path))
    rows = {}
    for r in df.collect():
        rows.setdefault(r.path.rsplit("/", 1)[1].split(".")[0], []).append(r)
    items = lambda k: [(r.tier, r.xmin, r.xmax, r.label) for r in sorted((r for r in rows[k] if r.level == "item"), key=lambda r: (r.tier_idx, r.item_idx))]
    assert items("long") == items("wide") == [("words", 0.0, 1.25, 'say "hi"'), ("words", 1.25, 2.5, ""), ("marks", 1.5, 1.5, "é")]
    assert [(r.level, r.tier, r.xmin, r.xmax) for r in rows["long"] if r.level != "item"] == [("file", None, 0.0, 2.5), ("tier", "words", 0.0, 2.5), ("tier", "marks", 0.0, 2.5)]
    assert {r.encoding for r in rows["wide"]} == {"utf-16-le-bom"} and {r.encoding for r in rows["short"]} == {"ascii"}
    # The old short header, an empty tier, numbers without digits before or behind the point, numbers inside labels.
    assert [(r.level, r.tier, r.xmin, r.xmax, r.label) for r in rows["old"]] == [("file", None, 0.0, 5.0, None), ("tier", "none", 0.5, 5.0, None), ("tier", "x [2] 3", 0.0, 10.0, None), ("item", "x [2] 3", -0.25, -0.25, 'a "3" [4]')]
    assert [(r.level, r.xmax) for r in rows["tierless"]] == [("file", 2.5)]
    assert all([r.level for r in rows[k]] == ["error"] and rows[k][0].error for k in ("cut", "more", "odd", "mark", "bare", "other", "class"))
    one = df.where("path rlike 'long|wide'")
    assert sorted(r.label for r in textgrid.tier(one, "words").collect()) == ["", "", 'say "hi"', 'say "hi"']
    with pytest.raises(Exception, match="0 tiers named words"):
        textgrid.tier(df, "words").collect()


def test_answers(spark, tmp_path):
    (tmp_path / "D1_A_w0_sample0.txt").write_text("[1, 4]")
    (tmp_path / "D1_A_w0_sample1.txt").write_text("sorry")
    cache = responses.read(spark, str(tmp_path))
    keys = ["doc_id", "condition", "win", "sample"]
    wanted = spark.createDataFrame([("D1", "A", 0, s, f"p{s}") for s in range(3)], "doc_id string, condition string, win int, sample int, prompt string")

    def client():
        calls = []
        return lambda p: calls.append(p) or (f"[{len(calls)}]" if calls.count(p) > 1 else "not yet")

    got = {r.sample: r for r in responses.complete(wanted, cache, keys, client).collect()}
    assert got[0].starts == [1, 4] and got[0].cached and not got[1].cached and got[1].reason is None and got[2].reason is None


def test_streams(spark, tmp_path):
    ok = [("ok",)] * 30
    for name, rows in (("good", ok), ("bad", ok + [("fail",)] * 10)):
        spark.createDataFrame(rows, "status string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        s = spark.readStream.schema("status string").parquet(f"{tmp_path}/{name}")
        q = draws.guarded(s, f"{tmp_path}/{name}_out", f"{tmp_path}/{name}_cp")
        if name == "good":
            q.awaitTermination()
            assert spark.read.parquet(f"{tmp_path}/good_out").count() == 30
        else:
            with pytest.raises(Exception, match="10 of 40"):
                q.awaitTermination()
            assert not (tmp_path / "bad_out").exists()
    # A stream that goes on after a restart still knows what it counted before.
    spark.createDataFrame([("fail",)] * 3 + [("ok",)] * 2, "status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/good")
    s = spark.readStream.schema("status string").parquet(f"{tmp_path}/good")
    draws.guarded(s, f"{tmp_path}/good_out", f"{tmp_path}/good_cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good_out").count() == 35
    spark.createDataFrame([("fail",)], "status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/good")
    with pytest.raises(Exception, match="4 of 36"):
        draws.guarded(spark.readStream.schema("status string").parquet(f"{tmp_path}/good"), f"{tmp_path}/good_out", f"{tmp_path}/good_cp").awaitTermination()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, 1), ("b", None, 2), ("c", float("nan"), 3)], "k string, x double, n long")
    assert list(sinks.markdown(df, "k"))[2:] == ["| a | 1.2346 | 1 |", "| b |  | 2 |", "| c |  | 3 |"]
    sinks.write_csv(sinks.rounded(df), f"{tmp_path}/csv")
    assert json.dumps([r.k for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()]) == '["a", "b", "c"]'

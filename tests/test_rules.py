"""Literal cases and brute-force comparisons for what SQL cannot state, and invariants of the page operators."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagestrata.functions import text as T
from pagestrata.operators import graphics as I
from pagestrata.operators import layout as H
from pagestrata.operators import lines as L
from pagestrata.operators import metrics as M
from pagestrata.operators import objects as B
from pagestrata.operators import ocr as O
from pagestrata.operators import pages as P
from pagestrata.operators import tables as J
from pagestrata.operators.common import grouped_map, numbered
from pagestrata.sources import files
from pagestrata.streaming import events as V


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("v")).first().v


# ── text ─────────────────────────────────────────────────────────────────────────────────────────────────────────


@pytest.mark.parametrize(
    "raw, want",
    [("\ufb01ne", "fine"), ("x\u00b2", "x2"), ("co-\n operate", "cooperate"), ("co-\n Operate", "co- Operate"), ("a\u200bb\u00adc", "abc"), ("\uf0b7 item", "\u2022 item"), ("a\u00a0 b ", "a b")],
)
def test_norm_text(spark, raw, want):
    assert one(spark, T.norm_text(F.col("s")), s=raw) == want


@pytest.mark.parametrize("raw, want", [("Año Nuevo/3", "Ano-Nuevo-3"), ("***", "doc"), ("a" * 80, "a" * 80)])
def test_slug(spark, raw, want):
    assert one(spark, T.slug(F.col("s")), s=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("iv.", [("lowerRoman", 4)]), ("c)", [("lowerLetter", 3), ("lowerRoman", 100)]), ("i.", [("lowerRoman", 1), ("lowerLetter", 9)]), ("07.", [("decimalZero", 7)]), ("[12]", [("decimal", 12)])],
)
def test_marker_readings(spark, raw, want):
    got = one(spark, T.parse_marker(F.col("s")), s=raw)
    assert [(c["format"], c["value"]) for c in got["candidates"]] == want


@pytest.mark.parametrize("raw", ["word", "", "abc def", "012", "--- "])
def test_not_a_marker(spark, raw):
    assert one(spark, T.parse_marker(F.col("s")), s=raw) is None


def test_private_bullet(spark):
    assert one(spark, T.parse_marker(F.col("s")), s="\uf0a7")["text"] == "\u25aa"


@pytest.mark.parametrize("a, b, want", [("ABCDEF+Helvetica-Bold", "ArialMT", True), ("Calibri-Light", "Calibri", False), ("Inter-SemiBold", "Inter", True), ("Type3_F1", "Times", True), ("Georgia", "Arial", False)])
def test_same_family(spark, a, b, want):
    assert one(spark, T.same_family(F.col("a"), F.col("b")), a=a, b=b) is want


# ── scores ───────────────────────────────────────────────────────────────────────────────────────────────────────


def matrix_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_bit_distance_is_exact():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 30))) for _ in range(2))
        assert M.bit_distance(a, b) == matrix_distance(a, b)


def test_text_similarity_long_and_short(spark):
    rnd = random.Random(1)
    a = "".join(rnd.choice("abc de") for _ in range(700))
    b = a[:300] + "x" * 40 + a[320:]
    rows = spark.createDataFrame([(1, a, b), (2, "kitten", "sitting"), (3, "", ""), (4, "same", "same")], "id int, a string, b string")
    got = {r.id: r.sim for r in M.text_similarity(rows, "a", "b", ["id"]).collect()}
    na, nb = (" ".join(s.split()) for s in (a, b))
    assert got[1] == pytest.approx(1 - matrix_distance(na, nb) / max(len(na), len(nb)), abs=1e-4)
    assert got[2] == pytest.approx(1 - 3 / 7, abs=1e-4) and got[3] is None and got[4] == 1.0


def test_longest_increasing():
    rnd = random.Random(2)
    for _ in range(200):
        s = [rnd.randint(0, 12) for _ in range(rnd.randint(0, 9))]
        subsets = [[v for i, v in enumerate(s) if m >> i & 1] for m in range(1 << len(s))]
        best = max(len(p) for p in subsets if all(x < y for x, y in zip(p, p[1:])))
        picked = [s[i] for i in M.rising(np.array(s))]
        assert len(picked) == best and all(x < y for x, y in zip(picked, picked[1:]))


def test_align_is_increasing_and_equal():
    rnd = random.Random(3)
    for _ in range(100):
        a = [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 25))]
        b = [t for t in a if rnd.random() > 0.2]
        got = M.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    words = [f"w{i}" for i in range(30)]
    assert len(M.align(words, words)) == 30
    assert len(M.align(words, words[15:] + words[:15], moves=True)) == 30
    assert M.align("a b a c".split(), "b a c a".split()) == [(1, 0), (2, 1), (3, 2)]


def test_order_score(spark):
    words = [f"w{i}" for i in range(40)]
    rows = spark.createDataFrame([(1, words, words), (2, words, words[20:] + words[:20]), (3, words, ["z"]), (4, list("abba"), list("abba")), (5, [], [])], "id int, a array<string>, b array<string>")
    got = {r.id: r for r in M.order_score(rows, "a", "b", "id").collect()}
    assert got[1].score == 1.0 and got[1].n == 3
    assert 0.4 < got[2].score < 0.6 and got[3].score is None and got[3].anchors == 0
    assert [(got[i].n, got[i].anchors, got[i].score) for i in (4, 5)] == [(1, 0, None)] * 2


def test_bag_f1_of_itself(spark):
    w = spark.createDataFrame([(1, t) for t in "a b a c".split()], "id int, t string")
    assert M.bag_f1(w, w, "id", "t").first().f1 == 1.0
    both = {r.id: (r.n_ref, r.f1) for r in M.bag_f1(w, w, "id", "t", spark.createDataFrame([(1,), (2,)], "id int")).collect()}
    assert both == {1: (4, 1.0), 2: (0, None)}


def test_table_match_prefers_best_unused(spark):
    ref = [(1, 0, 0, 0, "a"), (1, 0, 0, 1, "b"), (1, 1, 0, 0, "a"), (1, 1, 0, 1, "c")]
    cand = [(1, 5, 0, 0, "a"), (1, 5, 0, 1, "c"), (1, 6, 0, 0, "a"), (1, 6, 0, 1, "b")]
    schema = "doc_id bigint, table_no bigint, r int, c int, text string"
    got = {r.g: r for r in M.table_match(spark.createDataFrame(ref, schema), spark.createDataFrame(cand, schema)).collect()}
    assert got[0].k == 6 and got[1].k == 5 and got[0].pos == 1.0 and got[1].dims


def test_best_shift_finds_the_move(spark):
    rnd = np.random.default_rng(0)
    a = np.where(rnd.random((40, 50)) < 0.1, 0, 255)
    b = np.full_like(a, 255)
    b[2:, 3:] = a[:-2, :-3]
    rows = lambda m: spark.createDataFrame([(1, 0, y, [int(v) for v in r]) for y, r in enumerate(m)], "doc_id int, page_no int, y int, greys array<int>")
    r = M.best_shift(rows(a), rows(b), ["doc_id", "page_no"], 6).first()
    assert (r.dy, r.dx) == (-2, -3)


# ── pages ────────────────────────────────────────────────────────────────────────────────────────────────────────


def pages(spark, docs=3, n=7):
    return spark.createDataFrame([(d, p, 90 * (p % 4)) for d in range(docs) for p in range(1, n + d)], "doc_id bigint, page_no bigint, rotate int")


def test_split_then_merge_is_identity(spark):
    p = pages(spark)
    each = P.split_each(p.groupBy("doc_id").agg(F.max("page_no").cast("int").alias("total"), F.lit("b").alias("base")))
    back = P.merge_documents(each.select(F.col("doc_id").alias("target"), F.col("file_no").cast("bigint").alias("file_ord"), "page_no"))
    assert back.filter("new_page <> page_no").count() == 0 and back.count() == p.count()


def test_four_quarter_turns(spark):
    p = pages(spark)
    q = p
    for _ in range(4):
        q = P.rotate_pages(q, p.select("doc_id", "page_no", F.lit(90).alias("delta")))
    assert q.exceptAll(p.select(q.columns)).count() == 0


def test_delete_refuses_all_and_nothing(spark):
    p = pages(spark)
    marks = p.filter("doc_id = 0 OR (doc_id = 1 AND page_no = 2)").select("doc_id", "page_no")
    got = P.delete_pages(p, marks)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {1}
    assert sorted(r.new_page for r in got.collect()) == list(range(1, 7))


@pytest.mark.parametrize("text, columns", [("one two three", 7), ("abcdefghij k", 4), ("", 5), ("a\n\nb", 3), ("aaa bbbbbbbbb cc", 5)])
def test_wrap_text(spark, text, columns):
    want = []
    for para in text.split("\n"):
        if not para.strip():
            want.append("")
            continue
        line = ""
        for word in para.split():
            while len(word) > columns:
                want += [line] if line else []
                want.append(word[:columns])
                line, word = "", word[columns:]
            if line and len(line) + 1 + len(word) > columns:
                want.append(line)
                line = word
            else:
                line = f"{line} {word}" if line else word
        want += [line] if line else []
    assert one(spark, P.wrap_text(F.col("s"), columns), s=text) == want


def test_manifest_from_file(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"version": 1, "documents": [{"id": "Año 1", "pdf": "a.pdf", "gt": "a.docx"}, {"id": "Ano 1", "pdf": "b.pdf", "set": "x", "features": ["t"]}]}')
    rows = files.read_manifest(spark, str(tmp_path / "m.json")).orderBy("ord").collect()
    assert [r.id for r in rows] == ["Ano-1", "Ano-1-2"] and [r.set for r in rows] == ["manifest", "x"] and rows[0].features == []


def test_files_words_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(bytes.fromhex("89504E470D0A"))
    (tmp_path / "in" / "b.txt").write_bytes(b"text")
    found = files.read_files(spark, str(tmp_path / "in"))
    good, bad = files.accepted(found, ["png", "jpeg"])
    assert good.count() == 1 and bad.first().rejected == 1
    raw = spark.createDataFrame([(1, 0, 0, 0, 0, 0, "a", 0.0, 0.0, 5.0, 5.0, 90), (1, 0, 0, 1, 0, 1, "  ", 0.0, 9.0, 5.0, 5.0, 90), (1, 0, 1, 0, 0, 2, "b", 0.0, 19.0, 5.0, 5.0, 90)], "doc_id int, page_no int, block int, para int, line int, word_no int, text string, x double, y double, w double, h double, confidence int")
    raw.write.parquet(str(tmp_path / "words"))
    assert [(r.line, r.paragraph) for r in files.read_words(spark, str(tmp_path / "words")).orderBy("word_no").collect()] == [(0, 0), (1, 1)]
    files.write_results(spark.createDataFrame([("r1", 1, 0.5)], "run string, doc_id int, score double"), str(tmp_path / "res"))
    files.write_results(spark.createDataFrame([("r2", 1, 0.7)], "run string, doc_id int, score double"), str(tmp_path / "res"))
    files.write_results(spark.createDataFrame([("r2", 1, 0.8)], "run string, doc_id int, score double"), str(tmp_path / "res"))
    assert sorted(r.score for r in spark.read.parquet(str(tmp_path / "res")).collect()) == [0.5, 0.8]


# ── glyphs, graphics, tables, layout ─────────────────────────────────────────────────────────────────────────────

GLYPH = "doc_id int, page_no int, seq int, text string, ws boolean, x double, y double, size double, color string, bold boolean, invisible boolean"


def test_shadow_and_fake_bold(spark):
    def word(seq, dx, dy, hidden=False):
        return [(1, 0, seq + i, c, False, 100.0 + 6 * i + dx, 50.0 + dy, 12.0, "000000", False, hidden) for i, c in enumerate("cat")]

    shadowed = L.dedupe_overprints(spark.createDataFrame(word(0, 0, 0) + word(10, 1.5, 1.5), GLYPH)).collect()
    assert sorted(r.seq for r in shadowed) == [10, 11, 12] and not any(r.bold for r in shadowed)
    struck = L.dedupe_overprints(spark.createDataFrame(word(0, 0, 0) + word(10, 0.3, 0), GLYPH)).collect()
    assert len(struck) == 3 and all(r.bold for r in struck)
    layer = L.dedupe_overprints(spark.createDataFrame(word(0, 0, 0) + word(10, 0, 0, True), GLYPH)).collect()
    assert sorted(r.seq for r in layer) == [0, 1, 2]


def test_clean_fills(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 100.0, 50.0, "FF0000", 1.0), (1, 0, 2, 10.0, 10.0, 20.0, 20.0, "000000", 0.5), (1, 0, 3, 0.0, 60.0, 50.0, 5.0, "FFFFFF", 1.0), (1, 0, 4, 200.0, 0.0, 20.0, 20.0, "00FF00", 1.0), (1, 0, 5, 199.0, 0.0, 30.0, 30.0, "0000FF", 1.0)]
    f = spark.createDataFrame(rows, "doc_id int, page_no int, paint_order int, x double, y double, w double, h double, color string, opacity double")
    got = {r.paint_order: r.color for r in I.clean_fills(f).collect()}
    assert got == {1: "FF0000", 2: "800000", 5: "0000FF"}


def test_cluster_boxes_is_transitive(spark):
    b = spark.createDataFrame([(1, 0, i, 10.0 * i, 0.0, 9.0, 5.0) for i in range(6)] + [(1, 0, 9, 200.0, 0.0, 5.0, 5.0)], "doc_id int, page_no int, box_no int, x double, y double, w double, h double")
    assert sorted(r.members for r in I.cluster_boxes(b, 2.0).collect()) == [1, 6]
    many = spark.createDataFrame([(1, 0, i, 12.0 * (i % 64), 12.0 * (i // 64), 5.0 + 6.0 * (i < 10), 5.0) for i in range(4000)], "doc_id int, page_no int, box_no int, x double, y double, w double, h double")
    assert sorted(r.members for r in I.cluster_boxes(many, 2.0).collect())[-2:] == [1, 11]


def test_two_colors(spark):
    px = [(1, 250, 250, 250)] * 50 + [(1, 20, 18, 22)] * 9 + [(1, 90, 90, 92)] * 4
    r = I.two_colors(spark.createDataFrame(px, "id int, r int, g int, b int"), ["id"]).first()
    assert r.background == "FAFAFA" and r.ink == "000000"


def seg(d, pos, a, b):
    return (1, 0, d, float(pos), float(a), float(b), True)


SEG = "doc_id int, page_no int, dir string, pos double, a double, b double, ruled boolean"


def test_components_and_stacking(spark):
    grid = lambda x, y: [seg("h", y, x, x + 100), seg("h", y + 20, x, x + 100), seg("v", x, y, y + 20), seg("v", x + 50, y, y + 20), seg("v", x + 100, y, y + 20)]
    s = J.segment_components(spark.createDataFrame(grid(0, 0) + grid(0, 45) + grid(300, 0), SEG))
    assert J.component_boxes(s).count() == 3
    text = spark.createDataFrame([(1, 0, 5.0, 27.0, 30.0, 10.0), (1, 0, 55.0, 27.0, 30.0, 10.0)], "doc_id int, page_no int, x double, y double, w double, h double")
    assert J.component_boxes(J.stack_components(s, text)).count() == 2
    assert J.component_boxes(J.stack_components(s, text.filter("false"))).count() == 3


def test_stream_block_columns(spark):
    rows = [(1, 0, r, x, x + 40.0, 100.0 + 14 * r, 11.0) for r in range(4) for x in (0.0, 100.0, 200.0)] + [(1, 0, 9, 0.0, 400.0, 200.0, 11.0)]
    got = J.stream_blocks(spark.createDataFrame(rows, "doc_id int, page_no int, row_no int, x0 double, x1 double, baseline double, size double")).collect()
    assert len(got) == 12 and {r.col for r in got} == {0, 1, 2} and {r.block_no for r in got} == {0}


def test_merge_cells_needs_rectangles():
    assert list(J._merge_table(1, 3, [(0, 1, False, False)], [[], [], []])) == [0, 0, 2]
    assert list(J._merge_table(2, 2, [(0, 1, False, False), (1, 3, True, False)], [[], [], [], []])) == [0, 0, 2, 3]
    text = [[(0, 10, 10)], [(0, 10, 10)]]
    assert list(J._merge_table(1, 2, [(0, 1, False, False)], text)) == [0, 1]
    assert list(J._merge_table(1, 2, [(0, 1, False, True)], text)) == [0, 0]


def test_pick_largest_without_overlap(spark):
    t = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 100.0, 100.0), (1, 0, 1, 10.0, 10.0, 50.0, 50.0), (1, 0, 2, 200.0, 0.0, 50.0, 50.0)], "doc_id int, page_no int, table_no int, x double, y double, w double, h double")
    assert sorted(r.table_no for r in J.pick_tables(t).collect()) == [0, 2]


def test_two_columns_are_found(spark):
    rows = [(1, 0, i, 72.0 if i % 2 == 0 else 330.0, 100.0 + 14 * (i // 2), 230.0, 12.0, 110.0 + 14 * (i // 2), 12.0, True) for i in range(20)]
    rows.append((1, 0, 99, 72.0, 72.0, 450.0, 12.0, 82.0, 12.0, True))
    z = H.zones(spark.createDataFrame(rows, "doc_id int, page_no int, item_no int, x double, y double, w double, h double, baseline double, size double, is_text boolean")).collect()
    assert {r.kind for r in z if r.item_no < 20} == {"columns"}
    assert [r.region_no for r in sorted(z, key=lambda r: r.item_no)][:2] == [1, 2]


def test_list_restarts_when_count_breaks(spark):
    marks = ["1.", "2.", "4.", "5.", "•", "•"]
    rows = spark.createDataFrame([(1, 0, i, 0, m) for i, m in enumerate(marks)], "doc_id int, closes int, ord int, level int, m string")
    got = H.number_lists(rows.select("doc_id", "closes", "ord", "level", T.parse_marker(F.col("m")).alias("parsed"))).orderBy("ord").collect()
    assert [r.list_no for r in got] == [0, 0, 1, 1, 2, 2] and [r.value for r in got][:4] == [1, 2, 4, 5]


def test_paragraphs_break_on_short_line(spark):
    texts = [("A long first line of text that fills the width", 500.0), ("and runs on to here.", 200.0), ("Next paragraph starts right below the other", 500.0), ("and goes on", 150.0)]
    rows = [(1, 0, 0, i, t, 72.0, x1, 100.0 + 14 * i, 12.0, False, 30.0, False, 72.0, 0, 0.0, -1, 72.0, 500.0, 1.17) for i, (t, x1) in enumerate(texts)]
    r = spark.createDataFrame(rows, "doc_id int, page_no int, region_no int, row_no int, text string, x0 double, x1 double, baseline double, size double, bold boolean, first_w double, marked boolean, text_x double, tabs int, tab_x double, stack int, left double, wrap_right double, leading double")
    assert [p.para_id for p in H.group_paragraphs(r).orderBy("row_no").collect()] == [0, 0, 1, 1]


def test_snap_sizes():
    got = O._snap(np.array([9.8, 10.1, 10.2, 14.4, 14.6]), np.array([5.0, 40.0, 5.0, 9.0, 9.0]))
    assert list(got) == [10.0, 10.0, 10.0, 14.0, 14.0]


# ── streams ──────────────────────────────────────────────────────────────────────────────────────────────────────


def drain(stream, name, spark, mode="update"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_editor_undo_history():
    items, past = [], []
    for k in range(60):
        items, past = V.step(items, past, "add", str(k))
    for _ in range(60):
        items, past = V.step(items, past, "undo", None)
    assert items == [str(k) for k in range(10)]
    assert V.step([], [["a"]], "clear", None) == ([], [["a"]])


def test_streams_equal_batches(spark, tmp_path):
    log = [(d, s, a, i) for d in (1, 2) for s, (a, i) in enumerate([("add", "a"), ("add", "b"), ("remove", "a"), ("undo", None), ("clear", None), ("undo", None), ("add", "c")])]
    df = spark.createDataFrame(log, "doc_id bigint, seq bigint, action string, item_id string")
    df.write.parquet(str(tmp_path / "log"))
    got = drain(V.editor_state_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))), "editor_now", spark)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, V.replay_editor_events(df).collect()))
    stages = ["reading", "ocr", "analysing", "writing"]
    ev = spark.createDataFrame([(i, i % 3, stages[i % 4], 1 + i % 5, 5) for i in range(60)], "event_id bigint, job bigint, stage string, page int, pages int")
    ev.write.parquet(str(tmp_path / "ev"))
    got = drain(V.progress_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))), "progress_now", spark)
    assert Counter(map(tuple, got.select("job", "pct", "ocr_pages", "events").collect())) == Counter(map(tuple, V.progress(ev).select("job", "pct", "ocr_pages", "events").collect()))


def test_ingest_records_failures(spark, tmp_path):
    docs = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    convert = lambda df: df.withColumn("error", F.when(F.col("text") == "bad", "damaged"))
    w = V.ingest_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), convert, str(tmp_path / "out"), str(tmp_path / "failed"), str(tmp_path / "ck"))
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("NOT failed").count() == 1
    assert spark.read.parquet(str(tmp_path / "failed")).first().error == "damaged"


# ── keys, limits and blank pages ─────────────────────────────────────────────────────────────────────────────────


def test_groups_of_null_keys_and_across_batches(spark):
    rows = [(None, i) for i in range(5)] + [(1, i) for i in range(700)] + [(2, 0)]
    df = spark.createDataFrame(rows, "k int, v int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        out = grouped_map(df, ["k"], lambda p: pd.DataFrame({"k": [p["k"].iloc[0]], "n": [len(p)]}), "k double, n int").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.n for r in out) == [1, 5, 700]


def test_page_ranges_beyond_all_bounds(spark):
    df = spark.createDataFrame([("1-99999999999", 5), ("2-2000000000", 5), ("99999999999", 5), ("2-3", 5)], "s string, n int")
    got = [(r.p.pages, r.p.error) for r in df.select(T.page_ranges(F.col("s"), F.col("n")).alias("p")).collect()]
    assert got == [([], "out_of_range")] * 3 + [([2, 3], None)]


def test_blank_pages_and_unequal_widths(spark):
    a = spark.createDataFrame([(1, 0, [0, 255, 255]), (2, 0, [255, 255]), (3, 0, [0])], "p int, y int, greys array<int>")
    b = spark.createDataFrame([(1, 0, [0]), (2, 0, [255]), (3, 0, [255, 255])], "p int, y int, greys array<int>")
    ink = {r.p: r.f1 for r in M.ink_f1(M.ink_pixels(a, ["p"]), M.ink_pixels(b, ["p"]), ["p"], 2, a).collect()}
    assert ink == {1: 1.0, 2: 1.0, 3: 0.0}
    gray = {r.p: r["diff"] for r in M.gray_diff(a, b, ["p"]).collect()}
    assert gray[1] == 0.0 and gray[2] == 0.0 and gray[3] == pytest.approx(0.5, abs=1e-4)


def test_a_deep_graph_is_followed_to_its_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(130)], "src long, dst long")
    assert B.reachable(edges, spark.createDataFrame([(0,)], "node long")).count() == 131


def test_crowded_pages_keep_their_segments(spark):
    rules = spark.createDataFrame([(1, 0, "h", float(i), 0.0, 50.0, None) for i in range(5000)], "doc_id int, page_no int, dir string, pos double, a double, b double, style string")
    fills = spark.createDataFrame([], "doc_id int, page_no int, x double, y double, w double, h double")
    assert J.table_segments(rules, fills, 1e6).count() == 5000


def test_sparse_positions_of_a_hot_key_are_numbered_in_parts(spark):
    rows = [(1, i * 10**6 + i % 7) for i in range(20000)] + [(2, 5), (2, 6), (3, 0)]
    df = spark.createDataFrame(rows, "k int, pos long").repartition(5)
    got = {(r.k, r.pos): r.n for r in numbered(df, ["k"], "pos", "n").collect()}
    assert got == {(k, p): i + 1 for key in (1, 2, 3) for i, (k, p) in enumerate(sorted(x for x in rows if x[0] == key))}


def test_content_chunks_part_at_jumps_and_follow_letter_spacing(spark):
    at = [(0.0, 100.0), (5.0, 100.0), (10.0, 100.0), (15.0, 100.0), (300.0, 100.0), (0.0, 200.0), (13.0, 200.0), (26.0, 200.0), (45.0, 200.0)]
    g = spark.createDataFrame([(1, 0, i, "a", False, x, y, 10.0, 5.0, 5.0) for i, (x, y) in enumerate(at)], "doc_id long, page_no int, seq int, text string, ws boolean, x double, y double, size double, adv double, ink double")
    stats = spark.createDataFrame([(1, 0, 1.0)], "doc_id long, page_no int, limit double")
    # Gaps of 8 become the spacing of the line, so a gap of 14 still joins; from a fresh line it would not.
    assert [r.chunk for r in L.content_chunks(g, stats).orderBy("seq").collect()] == [0, 0, 0, 0, 1, 2, 2, 2, 2]
    fresh = g.filter("seq < 6").unionByName(g.filter("seq = 8").withColumn("x", F.lit(19.0)))
    assert [r.chunk for r in L.content_chunks(fresh, stats).orderBy("seq").collect()] == [0, 0, 0, 0, 1, 2, 3]

"""Operators that the driver tables don't reach: geometry, parsing, ladder, judge, store, streams."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.functions import tags
from leafmill.functions import text as tx
from leafmill.operators import cleaning, glossary, judging, ladder, screening, segmenting, storing, structure
from leafmill.sources import readers, rounds
from leafmill.streaming import running


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("47", True), ("- 47 -", True), ("[xii]", True), ("Page 9", True), ("3 of 12", True), ("Chapter 3", False), ("12345", False), ("", False), ("It was 47", False)],
)
def test_page_numbers(spark, text, want):
    assert value(spark, tx.is_page_number(F.lit(text))) is want


def test_normalize(spark):
    assert value(spark, tx.normalize_nfc(F.lit("ﬁ a  b​c é mi‌r"))) == "fi a bc é mi‌r"
    assert value(spark, tx.normalize_nfc(F.lit("يك"), "fa")) == "یک"
    assert value(spark, tx.normalize_nfc(F.lit("يك"), "ar")) == "يك"


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (9, 2), (5, 1), (36, 10)])
def test_tokens_round_half_even(spark, n, want):
    assert value(spark, tx.n_tokens(F.lit("x" * n))) == want


@pytest.mark.parametrize(("title", "want"), [("Chapter 12", 12), ("Chapter Seven", 7), ("Chapter XIV", 14), ("Prologue", None), ("Part ii", 2)])
def test_chapter_numbers(spark, title, want):
    assert value(spark, tx.chapter_number(F.lit(title))) == want


def test_wire_format():
    got = tags.parse_one('Hi\n<seg id="a">x</seg> mid <seg id="b" status="blocked">no</seg><seg id="a">y</seg><seg id="c"/><seg id="d">open')
    assert got["order"] == ["a", "b", "c"] and got["texts"] == {"a": "x"} and got["blocked"] == {"b": "no", "c": "blocked"}
    assert got["duplicates"] == ["a"] and got["malformed"] == 1 and got["stray"].startswith("Hi\nmid")
    assert tags.parse_one('```xml\n<seg id="a">x</seg>\n```')["texts"] == {"a": "x"}
    assert tags.parse_one(None)["order"] == []


def test_unclosed_segment_does_not_swallow(spark):
    wire = '<seg id="a">one <seg id="b">two</seg>'
    assert value(spark, tags.ids(F.lit(wire))) == ["b"] == tags.parse_one(wire)["order"]


@pytest.mark.parametrize("text", ["I'm sorry, but I can't do it", "As an AI I", "Here is the translation", "[Note]", "I have summarized it"])
def test_refusals(spark, text):
    assert value(spark, screening.refusal(F.lit(text))) is not None


@pytest.mark.parametrize("text", ["She was sorry that he could not come", "Aided by AI", "the note", "I can help you"])
def test_not_refusals(spark, text):
    assert value(spark, screening.refusal(F.lit(text))) is None


def test_inflected_terms_adhere(spark):
    assert value(spark, glossary.adheres(F.lit("der Wärter"), F.lit("Er gab dem Wärters Hund")))
    assert not value(spark, glossary.adheres(F.lit("Herrenhaus Ravenscroft"), F.lit("in Ravenscroft")))
    assert value(spark, glossary.adheres(F.lit(""), F.lit("x")))


LINE = "book_id string, page int, line_ord int, text string, size double, bold boolean, x0 double, x1 double, top double, bottom double, page_width double, page_height double, body_size double, column int, reading int"


def line(page, k, text, size=11.0, x0=45.0, x1=375.0, top=None, height=11.0):
    top = 100.0 + 15 * k if top is None else top
    return ("b", page, k, text, size, False, x0, x1, top, top + height, 420.0, 595.0, 11.0, 0, k)


def test_furniture(spark):
    rows = []
    for p in range(1, 7):
        rows += [line(p, 0, "The Long Winter", 8.0, top=20.0, height=8.0), line(p, 1, f"Body {p} text that differs {'x' * p}"), line(p, 9, str(40 + p), 8.0, top=570.0, height=8.0)]
    kept, audit = cleaning.strip_furniture(spark.createDataFrame(rows, LINE))
    assert kept.count() == 6 and {(r.reason, r.text) for r in audit.collect()} == {("running-head", "The Long Winter")} | {("page-number", str(40 + p)) for p in range(1, 7)}


def test_paragraphs_run_over_pages(spark):
    rows = [line(1, 0, "It was a dark and"), line(1, 1, "stormy night."), line(1, 2, "Next one be-", top=160.0), line(2, 0, "gins here and goes on"), line(2, 1, "• item")]
    broken = cleaning.paragraph_breaks(spark.createDataFrame(rows, LINE))
    got = [r.text for r in cleaning.paragraphs(broken).orderBy("ordinal").collect()]
    assert got == ["It was a dark and stormy night.", f"Next one be-{cleaning.BREAK}gins here and goes on", "• item"]


def test_dehyphenation_by_frequency(spark):
    b = cleaning.BREAK
    rows = [("k", 1, f"the be-{b}ginning and a well-{b}known man"), ("k", 2, "beginning again; a well-known and well-known one; x-" + b + "1 y")]
    got = {r.ordinal: r.text for r in cleaning.dehyphenate(spark.createDataFrame(rows, "book_id string, ordinal int, text string"), "book_id", "ordinal").collect()}
    assert got[1] == "the beginning and a well-known man" and got[2].endswith("x-1 y")


def test_footnotes(spark):
    rows = [line(1, 0, "Body text"), line(1, 1, "more body"), line(1, 2, "1. A note that is", 7.0), line(1, 3, "two lines long", 7.0), line(1, 4, "2) Another", 7.0)]
    marked = cleaning.footnote_lines(spark.createDataFrame(rows, LINE))
    notes = cleaning.group_footnotes(marked.where("is_note"))
    assert sorted((r.label, r.text) for r in notes.collect()) == [("1", "A note that is two lines long"), ("2", "Another")]


def test_columns(spark):
    rows = [("b", 1, k, f"l{k}", 9.0, False, 40.0 if k < 6 else 230.0, 200.0, 100.0 + 40 * (k % 6), 109.0 + 40 * (k % 6), 420.0, 595.0, 9.0) for k in range(12)]
    schema = LINE.replace(", column int, reading int", "")
    got = cleaning.assign_columns(spark.createDataFrame(rows, schema))
    assert [r.column for r in got.orderBy("line_ord").collect()] == [0] * 6 + [1] * 6


def test_spans(spark):
    box = (45.0, 10.0, 200.0, 21.0)
    rows = [("b", 420.0, 595.0, 0, 0, 0, box, [("Big", 20.0, "f", True, False, box), (" and the rest of it", 11.0, "f", False, False, box)], 1)]
    frame = spark.createDataFrame(rows, "book_id string, page_width double, page_height double, line_ord int, column int, block_index int, bbox struct<x0:double,y0:double,x1:double,y1:double>, spans array<struct<text:string,size:double,font:string,bold:boolean,italic:boolean,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>, page int")
    r = cleaning.flatten_spans(frame).first()
    assert (r.text, r.size, r.bold, r.x0) == ("Big and the rest of it", 11.0, False, 45.0)


def test_chapters(spark):
    rows = [("b", 0, "A preface", "paragraph", None), ("b", 1, "Chapter 1", "heading", 1), ("b", 2, "t", "paragraph", None), ("b", 3, "Chapter Two", "heading", 1), ("c", 0, "only text", "paragraph", None)]
    got = structure.chapters_from_headings(spark.createDataFrame(rows, "book_id string, ordinal int, text string, kind string, level int"))
    assert sorted((r.book_id, r.chapter, r.title, r.number) for r in got.collect()) == [("b", 1, "Front matter", None), ("b", 2, "Chapter 1", 1), ("b", 3, "Chapter Two", 2), ("c", 1, "(untitled)", None)]


def test_outline(spark):
    entries = spark.createDataFrame([("b", 0, "The Start", 1), ("b", 1, "The End", 2)], "book_id string, entry int, title string, page int")
    rows = spark.createDataFrame([("b", 0, "noise", [1]), ("b", 1, "The Start", [1]), ("b", 2, "x", [2]), ("b", 3, "THE END of it", [3])], "book_id string, ordinal int, text string, pages array<int>")
    assert sorted((r.entry, r.ordinal) for r in structure.match_outline(entries, rows).collect()) == [(0, 1), (1, 3)]


def test_batches(spark):
    rows = [("b", 1, k, "x" * n) for k, n in enumerate([2000, 2000, 5000, 100, 2200, 10])]
    units = segmenting.units(spark.createDataFrame(rows, "book_id string, doc_id int, pos int, text string"))
    got = [(r.batch, r.oversized) for r in segmenting.batches(units).orderBy("pos").collect()]
    assert got == [(0, False), (0, False), (1, True), (2, False), (2, False), (2, False)]


def test_best_attempt(spark):
    rows = [("a", 1, "x", True, 90.0, False), ("a", 2, "y", True, 85.0, False), ("b", 1, "x", False, 50.0, False), ("b", 2, "y", False, 50.0, False), ("b", 3, "z", False, None, True), ("c", 1, " ", False, None, True)]
    frame = spark.createDataFrame(rows, "segment_id string, attempt_no int, text string, passed boolean, composite double, critical boolean")
    assert {r.segment_id: (r.attempt_no, r.needs_review) for r in ladder.best_attempt(frame, "segment_id").collect()} == {"a": (2, False), "b": (1, True)}
    segments = spark.createDataFrame([("a", "s"), ("c", "s")], "segment_id string, source_text string")
    assert {r.segment_id: (r.final_text, r.needs_review) for r in ladder.outcomes(segments, frame, "segment_id").collect()} == {"a": ("y", False), "c": ("s", True)}


@pytest.mark.parametrize(("behaviour", "texts"), [("echo", 3), ("reverse", 3), ("drop", 2), ("invent", 4), ("duplicate", 3), ("malformed", 1), ("refuse", 0), ("degenerate", 3), ("passthrough", 3), ("chatty", 3)])
def test_scripted_models(behaviour, texts):
    said = ladder.scripted(behaviour, every=3)(["b1", "b2", "b3"], ["one x", "two", "three"], 1)
    assert len(tags.parse_one(said)["texts"]) == texts


def test_ladder_asks_again_and_gives_up(spark, tmp_path):
    batches = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y", "z"]), (2, ["d"], ["w"])], "batch_id long, ids array<string>, texts array<string>")
    done = ladder.run(batches, ladder.scripted("drop", every=3), lambda s, t: F.length(t) > 0, rounds.store_rounds(spark, str(tmp_path)))
    assert done.groupBy("segment_id").count().orderBy("segment_id").collect() == [("a", 3), ("b", 3), ("c", 3), ("d", 1)]


def test_throttle(spark):
    rows = [("m", k, float(k)) for k in range(8)]
    got = [r["wait"] for r in ladder.throttle(spark.createDataFrame(rows, "m string, k int, at double"), "m", ["k"], "at", F.lit(4.0), 1.0, 6.0).orderBy("k").collect()]
    level, at, want = 6.0, None, []
    for _, _, t in rows:
        now = max(t, at if at is not None else t)
        level = min(6.0, level + (now - (at if at is not None else now)))
        wait = max(0.0, 4.0 - level)
        want.append(now + wait - t)
        level, at = max(level + wait - 4.0, 0.0), now + wait
    assert got == want


def test_judge(spark):
    said = '```json\n{"scores":[{"segment_id":"a","completeness":60,"accuracy":90,"terminology":90,"fluency":90,"formatting":90},{"segment_id":"a","completeness":1,"accuracy":1,"terminology":1,"fluency":1,"formatting":1}],"issues":[{"segment_id":"a","severity":"major","description":"d","source_excerpt":null},{"segment_id":"a"}]}\n```'
    frame = spark.createDataFrame([(1, said), (2, "no json")], "batch_id int, response string").withColumn("judgement", judging.parse("response"))
    (score,) = judging.scores(frame, "batch_id").collect()
    assert score.composite == 79.5
    (issue,) = judging.issues(frame, "batch_id").collect()
    assert (issue.explanation, issue.source_excerpt, issue.dimension) == ("d", "", "other")
    assert value(spark, judging.verdict(F.lit(90.0), F.lit(60), F.lit(False))) == "incomplete"
    assert value(spark, judging.verdict(F.lit(90.0), F.lit(90), F.lit(False))) is None


def test_readers(spark):
    books = spark.createDataFrame([("b", "# Title\n\n> quote\ntext\n---\n---\n## Two\n{3}\nlast")], "book_id string, text string")
    got = [(r.page, r.text, r["size"], r.x0) for r in readers.markdown_lines(books).orderBy("page", "line_ord").collect()]
    assert got == [(1, "Title", 20.0, 45.0), (1, "quote", 10.0, 75.0), (1, "text", 10.0, 45.0), (2, "Two", 17.0, 45.0), (3, "last", 10.0, 45.0)]
    lines = spark.createDataFrame([("b", 1, 0, "bad", 0.0, 0.0, 0.0), ("b", 2, 0, "good", 0.0, 0.0, 0.0)], "book_id string, page int, line_ord int, text string, x0 double, top double, size double")
    new = spark.createDataFrame([("b", 1, "fresh\n\nlines"), ("b", 2, " ")], "book_id string, page int, text string")
    assert sorted(r.text for r in readers.apply_transcriptions(lines, new).collect()) == ["fresh", "good", "lines"]
    with pytest.raises(ValueError, match="no extractor"):
        readers.extract(lines, "nothing")


def test_registered_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ntwo")
    (tmp_path / "b.pdf").write_bytes(b"!")

    def read(content):
        if content == b"!":
            raise ValueError("unreadable")
        return ({"page": 1, "line_ord": k, "spans": []} for k, _ in enumerate(content.split()))

    readers.register(readers.Extractor("words", read))
    got = readers.extract(readers.whole_files(spark, str(tmp_path)), "words").collect()
    assert sorted((r.error or "", r.line_ord) for r in got if r.error is None) == [("", 0), ("", 1)] and sum(r.error == "unreadable" for r in got) == 1


def test_document_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"version": 1, "title": "t", "blocks": [{"id": "b0000", "kind": "paragraph", "text": "x", "translate": true}]}')
    assert readers.document_json(spark, str(tmp_path)).selectExpr("blocks[0].text").first()[0] == "x"


def test_store(spark):
    old = spark.createDataFrame([("j", "a", 1)], "job_id string, source string, n int")
    new = spark.createDataFrame([("j", "a", 2), ("j", "b", 3)], "job_id string, source string, n int")
    assert sorted(map(tuple, storing.upsert_glossary(old, new).collect())) == [("j", "a", 2), ("j", "b", 3)]
    assert sorted(map(tuple, storing.insert_absent(old, new, "job_id", "source").collect())) == [("j", "a", 1), ("j", "b", 3)]
    with pytest.raises(ValueError, match="can't change"):
        storing.update(old, {"n": F.lit(1)}, F.lit(True))


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("c", k, k % 2 == 0) for k in range(20)], "chapter string, ordinal int, failed boolean")
    rows.write.parquet(source)
    stream = running.breaker_stream(running.read_stream(spark, source, rows.schema))
    q = stream.writeStream.format("memory").queryName("breaker").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("breaker").first()[1:] == (20, 10, True)
    q = running.append_batches(running.read_stream(spark, source, rows.schema), out, str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 20


def test_usage_windows_drop_late_rows(spark, tmp_path):
    source = str(tmp_path / "usage")
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "m", 1.0), ("2024-01-01 00:50:00", "m", 2.0), ("2024-01-01 05:00:00", "m", 4.0)], "ts string, model string, cost_usd double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(source)
    q = running.usage_windows(running.read_stream(spark, source, rows.schema)).writeStream.format("memory").queryName("usage").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.calls, r.cost_usd) for r in spark.table("usage").collect()] == [(2, 3.0)]


def test_redaction(spark):
    fields = F.create_map(F.lit("api_key"), F.lit("x"), F.lit("prompt_tokens"), F.lit("12"), F.lit("note"), F.lit("use hf_ABCDEFGHIJKLMNOP12"))
    assert value(spark, tx.redact_fields(fields)) == {"api_key": tx.REDACTED, "prompt_tokens": "12", "note": f"use {tx.REDACTED}"}


def test_schemas():
    assert len(schemas.BLOCK_KINDS) == 12 and "text" in schemas.BLOCK.names


def test_epub_round_trip(spark):
    from leafmill.operators import archives

    books = spark.createDataFrame([("b1", "T & t", "fa", [("One", '<p id="b1">x<br>\ny</p>'), ("Empty", " "), ("Two", '<hr class="s">')])], "book_id string, title string, lang string, chapters array<struct<title:string,html:string>>")
    files = archives.epub_files(books)
    assert archives.epub_findings(files).count() == 0
    content = bytes(files.first().content)
    assert archives.epub_problems(content[:200])[0][0] == "error:archive" and archives.epub_problems(content) == []


@pytest.mark.parametrize("area", ["mimetype", "container", "metadata", "manifest", "spine", "content"])
def test_epub_corruption(area):
    import io
    import zipfile

    from leafmill.operators import archives

    z = zipfile.ZipFile(io.BytesIO(archives.epub("b", "t", "en", [("One", "<p>x</p>")])))
    files = {n: z.read(n).decode() for n in z.namelist()}
    change = {"mimetype": ("mimetype", "epub", "zip"), "container": (archives.CONTAINER, "content.opf", "none.opf"), "metadata": ("book/content.opf", "<dc:title>t</dc:title>", ""), "manifest": ("book/content.opf", "c000.xhtml", "c009.xhtml"), "spine": ("book/content.opf", 'idref="c0"', 'idref="c7"'), "content": ("book/c000.xhtml", "</p>", "")}
    name, old, new = change[area]
    files[name] = files[name].replace(old, new)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as w:
        for n, text in files.items():
            w.writestr(n, text)
    assert f"error:{area}" in {k for k, _ in archives.epub_problems(out.getvalue())}


def test_docx_and_typst(spark):
    import io
    import zipfile

    from leafmill.operators import archives, exporting

    books = spark.createDataFrame([("b", "en", "a **b** *c* <d>")], "book_id string, lang string, text string")
    runs = exporting.runs("text")
    rows = books.select("book_id", "lang", F.array(F.struct(F.lit("heading").alias("kind"), F.lit(9).alias("level"), runs.alias("runs"))).alias("blocks"))
    xml = zipfile.ZipFile(io.BytesIO(bytes(archives.docx_files(rows).first().content))).read("word/document.xml").decode()
    assert "Heading4" in xml and "<w:b/>" in xml and "&lt;d&gt;" in xml
    assert books.select(archives.typst_inline("text", runs)).first()[0] == "a #strong[b] #emph[c] \\<d\\>"


def test_summaries(spark):
    from leafmill.operators import summaries

    assert summaries.parse_selection("3-5, 12,4") == [3, 4, 5, 12]
    for bad in ("", "x", "5-3", "1--2"):
        with pytest.raises(ValueError):
            summaries.parse_selection(bad)
    assert value(spark, summaries.prompt("to {lang}: {text}", lang=F.lit("de"), text=F.lit("x"))) == "to de: x"
    with pytest.raises(ValueError, match="no value"):
        summaries.prompt("{a}")
    assert [value(spark, summaries.is_transient(F.lit(s), F.lit(k))) for s, k in ((429, ""), (503, ""), (400, ""), (0, "timeout"))] == [True, True, False, True]
    pages = spark.createDataFrame([("b", 1, 2), ("b", 2, 1), ("b", 3, 2)], "book_id string, page int, columns int")
    assert summaries.majority_columns(pages).first().columns == 2
    assert summaries.bars_svg([("0-50", 2), ("50-60", 0)]).count("<rect") == 2


def test_settings():
    from leafmill.settings import load

    s = load({"batch_tokens": 300, "min_score": None}, {"batch_tokens": 400}, env={"LEAFMILL_MIN_SCORE": "85", "PATH": "x"})
    assert (s.batch_tokens, s.min_score, s.max_attempts) == (400, 85.0, 3)
    for bad in ({"nothing": 1}, {"batch_tokens": "many"}, {"batch_tokens": 1.5}):
        with pytest.raises(ValueError):
            load(bad)


def test_commits(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    storing.commit(spark.range(3), path, 1)
    storing.commit(spark.range(5), path, 2)
    assert storing.committed(spark, path).count() == 5
    os.remove(f"{path}/version=2/_SUCCESS")
    assert storing.committed(spark, path).count() == 3


def test_batching_cost_is_linear(spark):
    import time

    def seconds(n):
        rows = [("b", k % 10, k, "word " * 40) for k in range(n)]
        frame = segmenting.units(spark.createDataFrame(rows, "book_id string, doc_id int, pos int, text string"))
        began = time.time()
        assert segmenting.batches(frame).count() == n
        return time.time() - began

    seconds(200)
    small = seconds(200)
    assert seconds(2000) < max(40 * small, 5)
    assert seconds(200_000) < max(400 * small, 40)


def test_running_values_by_hand(spark):
    import random

    from pyspark.sql import functions as F

    from leafmill.operators import ranges

    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, 1, 5, -2]), rng.choice([None, "x", "y"])) for k in range(400)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, k int, n int, s string").repartition(5)
    got = ranges.running(frame, ["g"], ["k"], total=(ranges.SUM, F.col("n")), least=(ranges.LEAST, F.col("n")), last=(ranges.LAST, F.col("s")), at=(ranges.SUM, F.lit(1)))
    want, state = [], {}
    for g, k, n, s in sorted(rows, key=lambda r: r[1]):
        total, least, last, at = state.get(g, (0, None, None, 0))
        least = least if n is None else n if least is None else min(least, n)
        state[g] = (total + (n or 0), least, s if s is not None else last, at + 1)
        want.append((g, k, n, s, *state[g]))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert ranges.numbered(frame.limit(0), ["g"], ["k"], "at").count() == 0


def test_outline_matches_either_way(spark):
    entries = spark.createDataFrame([("b", 0, 1, "The  Long, Winter!", 1), ("b", 1, 2, "Two", 2), ("b", 2, 3, "Deep", 2), ("b", 3, 1, "Lost", 9)], "book_id string, entry int, level int, title string, page int")
    paragraphs = spark.createDataFrame([("b", 0, [1], "noise"), ("b", 1, [1], "the long winter of 1709"), ("b", 2, [2], "Deep"), ("b", 3, [3], "tw"), ("b", 4, [3], "Tw o")], "book_id string, ordinal int, pages array<int>, text string")
    assert sorted((r.entry, r.ordinal) for r in structure.match_outline(entries, paragraphs).collect()) == [(0, 1), (1, 3)]


def test_throttle_holds_no_queue(spark):
    rows = [(("a", "b", None)[k % 3], k, None if k in (0, 9) else float(k // 40 * 7), 30.0 + k % 5 * 40) for k in range(6000)]
    frame = spark.createDataFrame(rows, "m string, k long, at double, need double").repartition(3)
    got = ladder.throttle(frame, "m", ["k"], "at", F.col("need"), 0.01, 120.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan
    want = {}
    state = {}
    for m, k, t, need in rows:
        level, at = state.get(m, (120.0, None))
        now = max([x for x in (t, at) if x is not None], default=None)
        level = 120.0 if now is None else min(120.0, level + (now - (now if at is None else at)) * 0.01)
        wait = max(0.0, (min(need, 120.0) - level) / 0.01)
        want[k] = None if t is None else now + wait - t
        state[m] = (max(level + wait * 0.01 - min(need, 120.0), 0.0), None if now is None else now + wait)
    assert {r.k: r.wait for r in got.collect()} == want


def test_running_medians(spark):
    rows = [(("a", None)[k % 2], k, None if k % 7 == 0 else float(k * 7919 % 101)) for k in range(5000)]
    frame = spark.createDataFrame(rows, "g string, k long, x double").repartition(3)
    out = screening.running_median(frame, "x", "k", by="g")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got, seen = {r.k: (r.n, r.median) for r in out.collect()}, {"a": [], None: []}
    for g, k, x in rows:
        seen[g] = sorted([*seen[g], *([] if x is None else [x])])
        s = seen[g]
        assert got[k] == (len(s), (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 if s else None)
    assert [(r.n, r.median) for r in screening.running_median(frame.where("k < 3"), "x", "k").orderBy("k").collect()] == [(0, None), (1, 41.0), (2, 61.5)]


def test_normal_form_by_slices(monkeypatch):
    texts = ["e\u0301", None, "", "plain", "A\u030a" * 50, "\u1100\u1161", "x"]
    monkeypatch.setattr(tx, "NFC_BYTES", 20)
    got = tx._nfc.func(pa.array(texts))
    assert got.to_pylist() == ["\u00e9", None, "", "plain", "\u00c5" * 50, "\uac00", "x"]
    assert tx._nfc.func(pa.array([], pa.string())).to_pylist() == []

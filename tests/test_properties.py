"""Invariants over generated inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import tags
from leafmill.operators import segmenting

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
chapters = st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(1, 6000), min_size=1, max_size=30)), min_size=1, max_size=4, unique_by=lambda x: x[0])


@QUICK
@given(chapters)
def test_every_unit_in_one_batch(spark, given_chapters):
    rows = [("b", c, k, "x" * n) for c, sizes in given_chapters for k, n in enumerate(sizes)]
    units = segmenting.units(spark.createDataFrame(rows, "book_id string, doc_id int, pos int, text string"))
    placed = segmenting.renumbered(segmenting.batches(units))
    got = placed.collect()
    assert sorted((r.doc_id, r.pos) for r in got) == sorted((c, k) for _, c, k, _ in rows)
    by_batch = {}
    for r in got:
        by_batch.setdefault(r.batch_no, []).append(r)
    assert sorted(by_batch) == list(range(len(by_batch)))
    for some in by_batch.values():
        assert len({r.doc_id for r in some}) == 1
        assert sum(r.tokens + 12 for r in some) <= 1200 or (len(some) == 1 and some[0].oversized)
    order = [r.batch_no for r in sorted(got, key=lambda r: (r.doc_id, r.pos))]
    assert order == sorted(order)


texts = st.text(st.characters(blacklist_characters="<>", blacklist_categories=("Cs", "Cc")), max_size=40)


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, max_size=8))
def test_wire_format_round_trip(some):
    wire = "\n".join(f'<seg id="b{k}">{t}</seg>' for k, t in enumerate(some))
    got = tags.parse_one(wire)
    assert got["texts"] == {f"b{k}": t.strip() for k, t in enumerate(some)} and not got["stray"] and not got["malformed"]


@QUICK
@given(st.lists(texts, min_size=1, max_size=6))
def test_wire_format_of_both_engines(spark, some):
    rows = spark.createDataFrame([([(f"b{k}", t) for k, t in enumerate(some)],)], "segments array<struct<id:string,text:string>>")
    wire = rows.select(tags.render(F.col("segments")).alias("w"))
    r = wire.select("w", tags.ids(F.col("w")).alias("ids"), tags.bodies(F.col("w")).alias("bodies"), tags.parse("w").alias("p")).first()
    assert r.ids == [f"b{k}" for k in range(len(some))] == r.p.order
    assert dict(zip(r.ids, r.bodies, strict=True)) == r.p.texts

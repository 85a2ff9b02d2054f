"""Queries of judging, the ladder, reports, the store and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


from ..functions import text as tx
from ..operators import exporting, judging, ladder, ranges, reporting, segmenting, storing, structure
from ..settings import BUCKETS
from .registry import LINES, UNITS, lines, query, table
from .text_queries import KIND



def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as attempts: their number, five scores, a text that is sometimes missing, sometimes critical."""
    li = table(spark, sf_dir, "lineitem")
    score = lambda c: (F.floor(F.col(c)).cast("int") % 41 + 60).cast("int")
    return li.select(
        F.col("l_orderkey").alias("segment_id"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).alias("attempt_no"),
        score("l_quantity").alias("completeness"),
        score("l_extendedprice").alias("accuracy"),
        score("l_partkey").alias("terminology"),
        score("l_suppkey").alias("fluency"),
        (F.col("l_linenumber") * 7 % 41 + 60).cast("int").alias("formatting"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("t"), "l_partkey")).alias("text"),
        (F.col("l_returnflag") == "R").alias("critical"),
    )


_ATTEMPTS = """attempts as (select l_orderkey as segment_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)::int as attempt_no, (floor(l_quantity)::int % 41 + 60)::int as completeness, (floor(l_extendedprice)::int % 41 + 60)::int as accuracy, (l_partkey % 41 + 60)::int as terminology, (l_suppkey % 41 + 60)::int as fluency, (l_linenumber * 7 % 41 + 60)::int as formatting,
 case when l_partkey % 11 = 0 then ' ' else 't' || l_partkey end as text, l_returnflag = 'R' as critical from lineitem)"""
#: The weights are multiples of 0.05, so hundredths are whole numbers and ties don't depend on binary sums.
_COMPOSITE = "round_even((35 * completeness + 30 * accuracy + 15 * terminology + 15 * fluency + 5 * formatting)::double / 100.0::double, 2)"
_SCORED = f"{_ATTEMPTS}, scored as (select *, {_COMPOSITE} as composite from attempts), judged as (select *, case when critical then 'critical' when completeness < 70 then 'incomplete' when composite < 80 then 'low' end as reason from scored)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attempts(spark, sf_dir).withColumn("composite", judging.composite())
    return rows.withColumn("reason", judging.verdict("composite", "completeness", F.col("critical"))).withColumn("passed", F.col("reason").isNull())


@query(f"with {_SCORED} select segment_id, attempt_no, composite from scored")
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("segment_id", "attempt_no", "composite")


@query(f"with {_SCORED} select segment_id, attempt_no, reason from judged")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("segment_id", "attempt_no", "reason")


@query(f"""with {_SCORED}, k as (select *, row_number() over (partition by segment_id order by (reason is null) desc, case when reason is null then -attempt_no::double else -(case when critical then -1.0 else composite end) end, attempt_no) as k from judged where reason is null or trim(text) <> '')
select segment_id, attempt_no, text, reason is not null as needs_review from k where k = 1""")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.best_attempt(_judged(spark, sf_dir), "segment_id").select("segment_id", "attempt_no", "text", "needs_review")


@query(f"""with {_SCORED}, k as (select *, row_number() over (partition by segment_id order by (reason is null) desc, case when reason is null then -attempt_no::double else -(case when critical then -1.0 else composite end) end, attempt_no) as k from judged where reason is null or trim(text) <> '')
select o.o_orderkey as segment_id, coalesce(k.text, o.o_orderpriority) as final_text, case when k.reason is null then k.composite end as final_score, coalesce(k.reason is not null, true) or k.segment_id is null as needs_review from orders o left join k on k.segment_id = o.o_orderkey and k.k = 1""")
def segment_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_orderpriority").alias("source_text"))
    return ladder.outcomes(segments, _judged(spark, sf_dir), "segment_id").select("segment_id", "final_text", "final_score", "needs_review")


@query("select o_orderkey, l_linenumber, o_orderstatus, l_quantity from orders left join lineitem on l_orderkey = o_orderkey and l_returnflag <> 'N'")
def attempt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderkey", "o_orderstatus")
    evals = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("attempt_id"), "l_linenumber", "l_quantity", F.lit(None).cast("long").alias("id"), F.col("l_shipdate").alias("created_at"))
    return reporting.history(attempts, evals).select("o_orderkey", "l_linenumber", "o_orderstatus", "l_quantity")


_SEV = ("minor", "critical", "major")


@query("""select event_id, 's' || event_id as segment_id, case when event_id % 4 = 0 then 'other' else 'accuracy' end as dimension, ['minor','critical','major'][(event_id % 3 + 1)::int] as severity, case when event_id % 5 = 0 then repeat('x', 399) || '…' else coalesce(event_type, '') end as source_excerpt, 'why ' || event_id as explanation from events where event_id % 6 <> 0""")
def judge_issue_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    issue = F.struct(
        F.concat(F.lit("s"), "event_id").alias("segment_id"),
        F.when(F.col("event_id") % 4 != 0, "accuracy").alias("dimension"),
        F.when(F.col("event_id") % 6 != 0, F.element_at(F.array(*[F.lit(x) for x in _SEV]), (F.col("event_id") % 3 + 1).cast("int"))).alias("severity"),
        F.when(F.col("event_id") % 5 == 0, F.repeat(F.lit("x"), F.lit(500))).otherwise(F.col("event_type")).alias("source_excerpt"),
        F.concat(F.lit("why "), "event_id").alias("description"),
    )
    said = ev.select("event_id", F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(F.array(issue).alias("issues"))), F.lit("\n```")).alias("response"))
    parsed = said.select("event_id", judging.parse("response").alias("judgement"))
    return judging.issues(parsed, "event_id").select("event_id", "segment_id", "dimension", "severity", "source_excerpt", "explanation")


@query("select event_id, event_id % 10 < 2 or event_id % 4 = 3 or (('0x' || substr(sha256(event_id::varchar), 1, 8))::bigint / 4294967296.0::double) < 0.25 as judged from events")
def evaluation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    judged = judging.is_judged(e % 10, e % 10 == 1, e % 4 == 3, F.lit(False), F.lit(0.1), e, 0.25)
    return table(spark, sf_dir, "events").select("event_id", judged.alias("judged"))


@query("select o_orderstatus as status, count(*) as n from orders group by 1")
def segment_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.status_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "status")




@query("select low, high, (select count(*) from lineitem where 40 + l_quantity >= low and 40 + l_quantity < high) as n from (values " + ", ".join(f"({a}, {b})" for a, b in BUCKETS) + ") b(low, high)")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.histogram(table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_quantity") + 40))


_LABELLED = "labelled as (select d.doc_id, source, text, (quality * 50 + doc_id % 50)::double as score, toxic = 1 as needs_review from documents d join labels using (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", "source", "text", (F.col("quality") * 50 + F.col("doc_id") % 50).cast("double").alias("score"), (F.col("toxic") == 1).alias("needs_review"))


@query(f"with {_LABELLED} select source, count(*) as segments, round_even(avg(score), 1) as mean_score, round_even(quantile_cont(score, 0.5), 1) as median_score, avg(needs_review::int) as review_share from labelled group by 1")
def chapter_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.means(_labelled(spark, sf_dir), "source")


@query(f"with {_LABELLED}, q as (select doc_id as id, case when doc_id % 9 = 0 then null else score end as score, needs_review, text from labelled) select id, score from q where trim(text) <> '' and (needs_review or score is null or score <= 40) order by coalesce(score, -1), id limit 50")
def review_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 != 0, F.col("score")).alias("score"), "needs_review", "text")
    return reporting.review_queue(rows, 40.0).select("id", "score").limit(50)


@query(f"with {_LABELLED} select doc_id as ordinal, score, needs_review from labelled where needs_review or score < 80 order by doc_id limit 200")
def flagged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.flagged(_labelled(spark, sf_dir).withColumn("ordinal", F.col("doc_id"))).select("ordinal", "score", "needs_review")


#: Values in whole cents, so that sums don't depend on their order.
_CENTS = "floor(value * 100)::bigint"


@query(f"select event_type as model, count(*) as calls, sum({_CENTS})::double as cost_usd from events group by 1")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.floor(F.col("value") * 100).cast("double").alias("cost_usd"))
    return reporting.usage_rollup(rows, "model")


@query(f"select event_id, coalesce(sum({_CENTS}) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::double as spent_before, coalesce(sum({_CENTS}) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) < 20000 as allowed from events")
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("cost_usd", F.floor(F.col("value") * 100).cast("double"))
    return ladder.budget_stop(rows, F.lit(20000.0), "user_id", "ts", "event_id").select("event_id", "spent_before", "allowed")


@query("""with f as (select event_id, user_id % 50 as chapter, ts, event_id % 3 = 0 or user_id % 4 = 1 as failed from events), c as (select *, sum(failed::int) over w as n_failed, count(*) over w as n_done from f window w as (partition by chapter order by ts, event_id rows between unbounded preceding and current row))
select event_id, chapter, n_failed::bigint as n_failed, n_done, max((n_failed >= 8 and n_failed::double / n_done >= 0.25)::int) over (partition by chapter order by ts, event_id rows between unbounded preceding and current row) = 1 as tripped from c""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("chapter"), "ts", ((F.col("event_id") % 3 == 0) | (F.col("user_id") % 4 == 1)).alias("failed"))
    return ladder.breaker(rows, "chapter", "ts", "event_id").select("event_id", "chapter", "n_failed", "n_done", "tripped")


@query("select event_id, row_number() over (partition by event_type order by ts, event_id) % 8 = 0 as refresh from events")
def summary_refresh_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.summary_points(table(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_id", "refresh")


def throttle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits behind a token bucket (a float recurrence; tests hold it against a plain loop)."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_timestamp("ts"))
    return ladder.throttle(rows, "event_type", ["ts", "event_id"], "at", F.lit(30.0), 0.01, 120.0)


query()(throttle_replay)


@query("with c as (select sha256(text) as f, min(doc_id) as cached from documents where doc_id % 2 = 0 group by 1) select d.doc_id, c.cached from documents d left join c on c.f = sha256(d.text)")
def prompt_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    cache = docs.where("doc_id % 2 = 0").groupBy("fingerprint").agg(F.min("doc_id").alias("output_text"))
    return storing.cache_lookup(docs, cache).select("doc_id", F.col("output_text").alias("cached"))


@query("select o_orderkey from orders where o_orderstatus <> 'F' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return storing.resume(table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), done, "o_orderkey").select("o_orderkey")


@query("select doc_id as id, 'missing' as side from documents where doc_id % 13 = 0 union all select doc_id + 1000000, 'extra' from documents where doc_id % 29 = 0")
def parallel_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    target = docs.where("id % 13 <> 0").unionByName(docs.where("id % 29 = 0").select((F.col("id") + 1000000).alias("id")))
    return storing.parallel_gaps(docs, target)


@query("select l_orderkey, l_linenumber, l_shipdate from (select *, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc) as k from lineitem) where k = 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storing.latest(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_shipdate", "l_linenumber").select("l_orderkey", "l_linenumber", "l_shipdate")


@query("""with a as (select o_orderkey as segment_id, o_orderpriority as source_text, 'final ' || o_orderkey as final_text, o_orderstatus as status from orders where o_orderkey % 3 <> 0), b as (select o_orderkey as segment_id, 'new ' || o_orderkey as source_text, null::varchar as final_text, 'pending' as status from orders where o_orderkey % 2 = 0)
select coalesce(a.segment_id, b.segment_id)::varchar as segment_id, coalesce(b.source_text, a.source_text) as source_text, coalesce(a.final_text, b.final_text) as final_text, coalesce(a.status, b.status) as status from a full join b on a.segment_id = b.segment_id""")
def upsert_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("job_id", F.lit("j"))
    missing = [F.lit(None).cast("double").alias("final_score"), F.lit(None).cast("boolean").alias("needs_review")]
    key = F.col("o_orderkey").cast("string").alias("segment_id")
    old = orders.where("o_orderkey % 3 <> 0").select("job_id", key, F.col("o_orderpriority").alias("source_text"), F.concat(F.lit("final "), "o_orderkey").alias("final_text"), F.col("o_orderstatus").alias("status"), *missing)
    new = orders.where("o_orderkey % 2 = 0").select("job_id", key, F.concat(F.lit("new "), "o_orderkey").alias("source_text"), F.lit(None).cast("string").alias("final_text"), F.lit("pending").alias("status"), *missing)
    return storing.upsert_segments(old, new).select("segment_id", "source_text", "final_text", "status")


@query("select l_orderkey, max(l_linenumber) + 1 as attempt_no from lineitem group by 1")
def attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storing.next_attempt(table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "attempt_no"), "l_orderkey")


@query("select doc_id, case when doc_id % 5 = 0 or doc_id % 5 = 1 then text else 'T ' || doc_id end as text from documents")
def apply_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    said = docs.where("id % 5 <> 0").select("id", F.when(F.col("id") % 5 == 1, "  ").otherwise(F.concat(F.lit("T "), "id")).alias("text"))
    return storing.apply_translations(docs, said).select(F.col("id").alias("doc_id"), "text")


_KEYS = ("sk-abcdefghijklmnop1234", "Bearer abcdef.ghijkl-mnopqrst", "hf_ABCDEFGHIJKLMNOP12", "nothing")
_CREDENTIAL = tx.CREDENTIAL.replace("'", "''")


@query(f"select doc_id, regexp_replace(text || ' ' || {list(_KEYS)}[(doc_id % 4 + 1)::int], '{_CREDENTIAL}', '{tx.REDACTED}', 'g') as text from documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.array(*[F.lit(x) for x in _KEYS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact(F.concat("text", F.lit(" "), key)).alias("text"))


_INLINE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g'), '\\*([^*\\n]+?)\\*', '<em>\\1</em>', 'g'), '`([^`\\n]+?)`', '<code>\\1</code>', 'g'), '\\[\\^([A-Za-z0-9_-]+)\\]', '<sup class=\"fn\"><a href=\"#fn-\\1\">\\1</a></sup>', 'g')"
_MARKED = "text || ' **b** and *e* & `c` <x>[^' || doc_id || ']'"


@query(f"select doc_id, {_INLINE} as html from (select doc_id, {_MARKED} as text from documents)")
def inline_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" **b** and *e* & `c` <x>[^"), "doc_id", F.lit("]"))
    return table(spark, sf_dir, "documents").select("doc_id", exporting.inline_html(text).alias("html"))


#: Kinds dealt over the lines, so that every form of output occurs.
_DEALT = ("paragraph", "heading", "blockquote", "list_item", "list_item", "verse", "scene_break", "page_break", "footnote", "figure_caption")


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in _DEALT]), (F.col("pos") % 10 + 1).cast("int"))
    return lines(spark, sf_dir).withColumn("kind", kind).withColumn("level", (F.col("pos") % 7).cast("int")).withColumn("id", tx.block_id("pos"))


_DEALT_SQL = f"dealt as (select *, {list(_DEALT)}[(pos % 10 + 1)::int] as kind, pos % 7 as level, printf('b%04d', pos) as id, regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as t from lines)"
_MD = "case kind when 'heading' then repeat('#', least(greatest(level, 1), 6)::int) || ' ' || t when 'blockquote' then '> ' || t when 'list_item' then '- ' || t when 'verse' then t || '  ' when 'scene_break' then '* * *' when 'page_break' then '---' when 'footnote' then '[^' || id || ']: ' || t when 'figure_caption' then '*' || t || '*' else t end"


@query(f"with {LINES}, {_DEALT_SQL} select doc_id, pos, {_MD} as md from dealt")
def block_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir).select("doc_id", "pos", exporting.block_markdown(F.col("kind"), F.col("level"), F.col("id"), F.col("text")).alias("md"))


_ATTRS = "' id=\"' || id || '\" class=\"b-' || kind || '\">'"
_HTML = f"case kind when 'heading' then '<h' || least(greatest(level, 1), 6) || {_ATTRS} || h || '</h' || least(greatest(level, 1), 6) || '>' when 'scene_break' then '<hr id=\"' || id || '\" class=\"scene-break\">' when 'page_break' then '<hr id=\"' || id || '\" class=\"page-break\">' when 'footnote' then '<p id=\"fn-' || id || '\" class=\"b-footnote footnote\"><span class=\"fn-label\">' || id || '</span> ' || h || '</p>' when 'blockquote' then '<blockquote' || {_ATTRS} || h || '</blockquote>' when 'list_item' then '<li' || {_ATTRS} || h || '</li>' else '<p' || {_ATTRS} || h || '</p>' end"


@query(f"with {LINES}, {_DEALT_SQL}, rendered as (select *, {_INLINE} as h from dealt) select doc_id, pos, {_HTML} as html from rendered")
def block_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir).select("doc_id", "pos", exporting.block_html(F.col("kind"), F.col("level"), F.col("id"), F.col("text")).alias("html"))


@query(f"with {LINES}, {_DEALT_SQL}, m as (select doc_id, pos, {_MD} as md from dealt) select doc_id, array_to_string(list(md order by pos), chr(10) || chr(10)) as text from m where trim(md) <> '' group by 1")
def chapter_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = exporting.block_markdown(F.col("kind"), F.col("level"), F.col("id"), F.col("text"))
    return exporting.joined(_dealt(spark, sf_dir), ["doc_id"], ["pos"], md)


@query(f"with {LINES}, {_DEALT_SQL} select doc_id, pos, kind = 'list_item' and coalesce(lag(kind) over w, '') <> 'list_item' as opens, kind = 'list_item' and coalesce(lead(kind) over w, '') <> 'list_item' as closes from dealt window w as (partition by doc_id order by pos)")
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exporting.list_edges(_dealt(spark, sf_dir), ["doc_id"], ["pos"]).select("doc_id", "pos", "opens", "closes")


@query(f"with {LINES}, {_DEALT_SQL} select doc_id, array_to_string(list(case when kind = 'heading' then upper(replace(text, 'ß', 'ss')) else text end order by pos), chr(10) || chr(10)) as text from dealt where trim(text) <> '' group by 1")
def chapter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exporting.joined(_dealt(spark, sf_dir), ["doc_id"], ["pos"], exporting.plain_text(F.col("kind"), F.col("text")))


@query("select doc_id, u.t as text, u.s as style, u.k::bigint as k from (select doc_id, unnest([{'k': 0, 't': 'a ', 's': 'plain'}, {'k': 1, 't': 'b' || doc_id, 's': 'strong'}, {'k': 2, 't': ' c ', 's': 'plain'}, {'k': 3, 't': 'd', 's': 'em'}, {'k': 4, 't': 'e', 's': 'code'}]) as u from documents)")
def inline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("a **b"), "doc_id", F.lit("** c *d*`e`"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(exporting.runs(text)).alias("k", "r")).select("doc_id", "r.text", "r.style", F.col("k").cast("long").alias("k"))


@query("select event_id, least(pow(2.0::double, event_id % 9), 60.0::double) as seconds, case when value < 0.01 then printf('$%.4f', value) when value < 1 then printf('$%.3f', value) else printf('$%.2f', value) end as usd from events")
def backoff_and_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.backoff(F.col("event_id") % 9).alias("seconds"), tx.usd("value").alias("usd"))


@query("select distinct event_type as model from events where event_type is not null and event_type <> 'human'")
def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.models(table(spark, sf_dir, "events").select(F.col("event_type").alias("model")))


@query(f"with {LINES}, {UNITS}, s as (select book_id, doc_id, pos, (row_number() over (partition by book_id order by doc_id, pos))::int as ordinal from (select book_id, doc_id, pos, {KIND} as kind from units) where kind not in ('scene_break', 'page_break')) select * from s")
def seeded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmenting.units(lines(spark, sf_dir).withColumn("kind", structure.kind_by_text("text")))
    placed = ranges.numbered(rows.select("book_id", "doc_id", "pos"), ["book_id"], ["doc_id", "pos"], "at")
    return placed.select("book_id", "doc_id", "pos", F.col("at").cast("int").alias("ordinal"))


def retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best attempts of a model that drops every third segment at first and answers well when asked again."""
    from ..sources.rounds import store_rounds

    rows = segmenting.units(lines(spark, sf_dir)).withColumn("id", tx.block_id("pos")).withColumn("text", tx.strip("text"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "id", "text")))
    batches = rows.groupBy(F.col("doc_id").alias("batch_id")).agg(F.transform(ordered, lambda x: x["id"]).alias("ids"), F.transform(ordered, lambda x: x["text"]).alias("texts"))

    def model(ids: list[str], texts: list[str], round_: int) -> str:
        return ladder.scripted("drop", every=3)(ids, texts, round_) if round_ == 1 else ladder.scripted("echo")(ids, texts, round_)

    done = ladder.run(batches, model, lambda source, text: F.length(F.trim(text)) > 0, store_rounds(spark))
    best = ladder.best_attempt(done.withColumn("composite", F.lit(None).cast("double")).withColumn("critical", F.lit(False)), "batch_id", "segment_id")
    return best.select("batch_id", "segment_id", "attempt_no", "text", "needs_review")


query(f"with {LINES}, {UNITS} select doc_id as batch_id, printf('b%04d', pos) as segment_id, case when max(k) over (partition by doc_id) >= 3 then 2 else 1 end as attempt_no, '[t] ' || text as text, false as needs_review from (select doc_id, pos, k, regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as text from units)")(retry_ladder)


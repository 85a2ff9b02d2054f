"""Queries of batching, estimates, the wire format, and screens of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tags
from ..functions import text as tx
from ..operators import estimating, glossary, screening, segmenting
from .registry import BATCHES, LINES, PAIRS, TOKENS, UNITS, lines, pairs, query, table


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenting.batches(segmenting.units(lines(spark, sf_dir)))


_PER = "per as (select book_id, doc_id, batch, count(*) as units, sum(tokens)::bigint as tokens, bool_or(oversized) as oversized from fold group by 1, 2, 3)"


@query(f"{BATCHES} select doc_id, pos, tokens, batch, oversized from fold")
def segment_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("doc_id", "pos", "tokens", "batch", "oversized")


@query(f"{BATCHES}, m as (select book_id, doc_id, batch, max(batch) over (partition by doc_id) + 1 as n, pos from fold), o as (select doc_id, coalesce(sum(n) over (partition by book_id order by doc_id rows between unbounded preceding and 1 preceding), 0) as first from (select distinct book_id, doc_id, n from m)) select doc_id, pos, (first + batch)::bigint as batch_no from m join o using (doc_id)")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenting.renumbered(_placed(spark, sf_dir)).select("doc_id", "pos", "batch_no")


@query(f"{BATCHES}, {_PER} select book_id, count(*) as batches, sum(units)::bigint as units, sum(tokens)::bigint as tokens, round_even(avg(units), 1) as mean_units, max(tokens) as max_tokens, count(*) filter (where oversized) as oversized from per group by 1")
def batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenting.statistics(segmenting.batch_rows(_placed(spark, sf_dir), ["book_id", "doc_id", "batch"]), "book_id")


@query(f"""{BATCHES}, c as (select *, list(text) over (partition by book_id order by doc_id, pos rows between 2 preceding and 1 preceding) as previous, list(text) over (partition by book_id order by doc_id, pos rows between 1 following and 1 following) as next from fold)
select doc_id, batch, array_to_string(arg_min(coalesce(previous, []), pos), '|') as previous, array_to_string(arg_max(coalesce(next, []), pos), '|') as next from c group by 1, 2""")
def batch_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenting.contexts(_placed(spark, sf_dir)).select("doc_id", "batch", F.array_join("previous", "|").alias("previous"), F.array_join("next", "|").alias("next"))


@query(f"{BATCHES}, {_PER} select doc_id, batch, ((floor(tokens * 3.0::double) + 512 + 12 * units + 4000) * (case when oversized then 2 else 1 end))::bigint as budget from per")
def completion_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = segmenting.batch_rows(_placed(spark, sf_dir), ["doc_id", "batch"])
    return per.select("doc_id", "batch", segmenting.completion_budget(F.col("tokens"), F.col("units"), F.col("oversized").cast("int")).alias("budget"))


_CONTEXT = "ctx as (select doc_id, batch, sum(tokens) filter (where r <= 2)::bigint as context from (select *, row_number() over (partition by doc_id, batch order by pos) as r from fold) group by 1, 2)"


def _phases(lo: float, hi: float, price: tuple[float, float], judge: tuple[float, float], rate: float = 0.15) -> str:
    def cost(p: tuple[float, float], c: str) -> str:
        return f"(prompt_tokens * {p[0]}::double + {c} * {p[1]}::double) / 1000000.0::double"

    lr, hr = rate * 0.4, min(rate * 2.0, 1.0)
    return f"""g as (select per.book_id, sum(tokens)::bigint as src, sum(units)::bigint as units, count(*) as b, sum(context)::bigint as context from per join ctx using (doc_id, batch) group by 1),
t as (select *, 12 * units as tags, src + 12 * units + context + 850 * b as t_in, floor(src * {lo}::double)::bigint + 12 * units as t_lo, floor(src * {hi}::double)::bigint + 12 * units as t_hi from g),
ph as (select book_id, 'translation' as phase, b as calls, t_in as prompt_tokens, t_lo as completion_low, t_hi as completion_high from t
 union all select book_id, 'evaluation', greatest(1, b), src + tags + t_hi + 700 * greatest(1, b), floor(55 * units * 0.7::double)::bigint, floor(55 * units * 1.4::double)::bigint from t where units > 0
 union all select book_id, 'back-translation', greatest(1, floor(greatest(1, b) * 0.2::double)::bigint), floor(t_hi * 0.2::double)::bigint, floor(src * 0.2::double * 0.8::double)::bigint, floor(src * 0.2::double * 1.2::double)::bigint from t
 union all select book_id, 'retries', round_even(b * {hr!r}::double, 0)::bigint, floor(t_in * {hr!r}::double * 1.6::double)::bigint, floor(t_lo * {lr!r}::double)::bigint, floor(t_hi * {hr!r}::double)::bigint from t)
select book_id, phase, calls::bigint as calls, prompt_tokens, completion_low, completion_high, case phase when 'evaluation' then {cost(judge, 'completion_low')} else {cost(price, 'completion_low')} end as cost_low, case phase when 'evaluation' then {cost(judge, 'completion_high')} else {cost(price, 'completion_high')} end as cost_high from ph"""


_MODEL, _JUDGE = "anthropic/claude-sonnet-4.5", "openai/gpt-4.1-mini"


@query(f"{BATCHES}, {_PER}, {_CONTEXT}, {_phases(1.05, 1.45, (3.0, 15.0), (0.4, 1.6))}")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    first = Window.partitionBy("doc_id", "batch").orderBy("pos")
    lead = placed.withColumn("_r", F.row_number().over(first)).groupBy("book_id", "doc_id", "batch").agg(F.count(F.lit(1)).alias("units"), F.sum("tokens").cast("long").alias("tokens"), F.sum(F.when(F.col("_r") <= 2, F.col("tokens"))).cast("long").alias("context"))
    return estimating.estimate(lead, "de", _MODEL, _JUDGE, ["book_id"], back_translation=0.2).drop("model")


@query("select source, target_lang, case target_lang when 'de' then 1.05 when 'zh-hans' then 0.6 when 'pt-br' then 1.1 else 0.85 end::double as low, target_lang in ('fa-ir') as rtl from (select distinct source, ['de','zh-hans','pt-br','fa-ir','xx'][(doc_id % 5 + 1)::int] as target_lang from documents) where target_lang <> 'fa-ir' union all select distinct source, 'fa-ir', 0.95::double, true from documents where doc_id % 5 = 3")
def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.element_at(F.array(*[F.lit(x) for x in ("de", "zh-hans", "pt-br", "fa-ir", "xx")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("source", lang.alias("target_lang")).distinct().select("source", "target_lang", tx.expansion("target_lang", False).alias("low"), tx.is_rtl("target_lang").alias("rtl"))


_ORDERED = "(select doc_id, list(text order by pos) as ts, list(printf('b%04d', pos) order by pos) as ids from units group by 1)"


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmenting.units(lines(spark, sf_dir)).withColumn("id", tx.block_id("pos"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id", "text"))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))
    return rows.groupBy("doc_id").agg(items.alias("segments"))


@query(f"with {LINES}, {UNITS} select doc_id, array_to_string(list_transform(range(1, len(ts) + 1), lambda i: '<seg id=\"' || ids[i] || '\">' || ts[i] || '</seg>'), chr(10)) as wire from {_ORDERED}")
def render_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wire(spark, sf_dir).select("doc_id", tags.render(F.col("segments")).alias("wire"))


@query(f"with {LINES}, {UNITS} select doc_id, array_to_string(ids, '|') as ids, array_to_string(list_transform(ts, lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '|') as texts from {_ORDERED}")
def parse_segments_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = _wire(spark, sf_dir).select("doc_id", tags.render(F.col("segments")).alias("wire"))
    fenced = F.concat(F.lit("```xml\n"), "wire", F.lit("\n```"))
    return wire.select("doc_id", tags.strip_fence(fenced).alias("wire")).select("doc_id", F.array_join(tags.ids(F.col("wire")), "|").alias("ids"), F.array_join(tags.bodies(F.col("wire")), "|").alias("texts"))


def parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stray text and malformed openings, by the Arrow form (tests hold it against fixtures)."""
    wire = _wire(spark, sf_dir).select("doc_id", F.concat(F.lit("Here you are:\n"), tags.render(F.col("segments")), F.lit('\n<seg id="x">open')).alias("wire"))
    return wire.select("doc_id", tags.parse("wire").alias("p")).select("doc_id", F.size("p.order").alias("n"), "p.stray", "p.malformed")


query()(parsed_responses)


@query(f"with {LINES}, {UNITS} select doc_id as batch_id, array_to_string(coalesce(list(printf('b%04d', pos) order by pos) filter (where k % 3 = 0), []), '|') as missing, 'b9999' as unexpected from units group by 1")
def segment_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmenting.units(lines(spark, sf_dir)).select(F.col("doc_id").alias("batch_id"), tx.block_id("pos").alias("id"), F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("ord"))
    extra = rows.select("batch_id").distinct().select("batch_id", F.lit("b9999").alias("id"), F.lit(100000).alias("ord"))
    got = rows.where("ord % 3 <> 0").unionByName(extra)
    found = screening.integrity(rows, got)
    return found.select("batch_id", F.array_join(F.array_sort("missing"), "|").alias("missing"), F.array_join("unexpected", "|").alias("unexpected"))


#: Answers that no conversation has, put after every seventh target and others.
_SAID = ("I'm sorry, but I really cannot do that.", "I can't translate this.", "As an AI I may not.", "[Translator's note]", "I have omitted a line.", "I must decline.", "All is well.")
_SAID_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _SAID) + "]"
_REFUSED = "case " + " ".join(f"when regexp_matches(target, '{p.replace(chr(39), chr(39) * 2)}') then '{k}'" for k, p in screening.REFUSALS) + " end"


@query(f"with {PAIRS}, p as (select conv_id, turn, target || ' ' || {_SAID_SQL}[(conv_id % 7 + 1)::int] as target from pairs) select conv_id, turn, {_REFUSED} as label from p")
def refusal_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("conv_id") % 7 + 1).cast("int"))
    return pairs(spark, sf_dir).withColumn("target", F.concat("target", F.lit(" "), said)).select("conv_id", "turn", screening.refusal("target").alias("label"))



_SHARE_EXACT = "case when len(w) < 15 then 0::double else ((len(w) - 4) - len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))))::double / (len(w) - 4) end"
_WORDS = "regexp_extract_all({0}, '[^\\s\\x0B\\x{{85}}\\p{{Z}}]+')"


@query(f"select doc_id, {_SHARE_EXACT} as share from (select doc_id, {_WORDS.format('text')} as w from documents)")
def ngram_repeat_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.repeated_share("text").alias("share"))


@query(f"with {PAIRS}, w as (select conv_id, turn, source, case when conv_id % 5 = 0 then repeat(target || ' ', 8) else target end as target from pairs), g as (select *, {_WORDS.format('target')} as w from w) select conv_id, turn, case when length(source) > 0 and length(target) > length(source) * 3.0::double and length(target) > 200 then 'length' when {_SHARE_EXACT} > 0.3 then 'loop' end as finding from g")
def degeneration_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("target", F.when(F.col("conv_id") % 5 == 0, F.repeat(F.concat("target", F.lit(" ")), F.lit(8))).otherwise(F.col("target")))
    return rows.select("conv_id", "turn", screening.degeneration("source", "target").alias("finding"))


@query(f"""with {PAIRS}, r as (select conv_id, turn, conv_id % 8 as lane, case when length(source) >= 40 then length(target)::double / length(source) end as ratio from pairs),
m as (select *, count(ratio) over w as n, quantile_cont(ratio, 0.5) over w as median from r window w as (partition by lane order by conv_id, turn rows between unbounded preceding and current row))
select conv_id, turn, ratio, n, median, ratio is not null and n >= 25 and abs(ratio - median) > 0.4 * median as outlier from m""")
def length_ratio_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("conv_id", "turn", (F.col("conv_id") % 8).alias("lane"), screening.length_ratio("source", "target").alias("ratio"))
    return screening.ratio_outliers(rows, "conv_id", "turn", by="lane").select("conv_id", "turn", "ratio", "n", "median", F.coalesce("outlier", F.lit(False)).alias("outlier"))


@query(f"""with {PAIRS}, p as (select conv_id, turn, source, case when conv_id % 4 = 0 then source else target end as target from pairs),
w as (select *, regexp_extract_all(source, '[\\p{{L}}]+') as ws, list_distinct(regexp_extract_all(lower(source), '[\\p{{L}}]+')) as a, list_distinct(regexp_extract_all(lower(target), '[\\p{{L}}]+')) as b from p)
select conv_id, turn, case when length(source) < 60 or length(target) < 60 or len(a) = 0 or len(b) = 0 then false when len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) > 0.4 * len(ws) then false else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) > 0.7 end as copied from w""")
def passthrough_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("target", F.when(F.col("conv_id") % 4 == 0, F.col("source")).otherwise(F.col("target")))
    return rows.select("conv_id", "turn", screening.passthrough("source", "target").alias("copied"))


def _numbers(of: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({of}, '[0-9][0-9.,/]*'), lambda x: regexp_replace(x, '[.,]+$', '')))"


@query(f"with d as (select doc_id, text || ' 12, 3.4 and ' || doc_id || '.' as source, regexp_replace(text, '[0-9]', '', 'g') || ' ۱۲' as target from documents), n as (select doc_id, {_numbers('source')} as a, {_numbers(chr(34) + 'folded' + chr(34))} as b from (select *, translate(target, '{tx.DIGITS_FROM}', '{tx.DIGITS_TO}') as folded from d)), m as (select doc_id, a, list_filter(a, lambda x: not list_contains(b, x)) as gone from n) select doc_id, case when len(a) >= 2 and len(gone) > len(a) / 2.0 then array_to_string(list_sort(gone)[1:5], '|') end as missing from m")
def numbers_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" 12, 3.4 and "), "doc_id", F.lit(".")).alias("source"), F.concat(F.regexp_replace("text", "[0-9]", ""), F.lit(" ۱۲")).alias("target"))
    return docs.select("doc_id", F.array_join(screening.missing_numbers("source", "target"), "|").alias("missing"))


#: Endings with odd marks, leaked tags and changed notes.
_MARKS = ("**bold", "a `code", "x *em", "</seg>", "see [^2]", "fine **b** *e*")
_MARKS_SQL = str(list(_MARKS))


@query(f"""with {PAIRS}, p as (select conv_id, turn, source || ' [^1]' as source, target || ' ' || {_MARKS_SQL}[(conv_id % 6 + 1)::int] as target from pairs),
r as (select *, list_sort(list_distinct(regexp_extract_all(source, '\\[\\^([A-Za-z0-9_-]+)\\]', 1))) as a, list_sort(list_distinct(regexp_extract_all(target, '\\[\\^([A-Za-z0-9_-]+)\\]', 1))) as b from p)
select conv_id, turn, contains(target, '<seg') or contains(target, '</seg>') as leak, len(regexp_extract_all(target, '\\*\\*')) % 2 = 1 as odd_strong, len(regexp_extract_all(target, '`')) % 2 = 1 as odd_code, len(regexp_extract_all(replace(target, '**', ''), '\\*')) % 2 = 1 as odd_em, array_to_string(list_filter(a, lambda x: not list_contains(b, x)), '|') as refs_dropped, array_to_string(list_filter(b, lambda x: not list_contains(a, x)), '|') as refs_invented from r""")
def markup_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(*[F.lit(x) for x in _MARKS]), (F.col("conv_id") % 6 + 1).cast("int"))
    rows = pairs(spark, sf_dir).select("conv_id", "turn", F.concat("source", F.lit(" [^1]")).alias("source"), F.concat("target", F.lit(" "), mark).alias("target"))
    return rows.select("conv_id", "turn", *[(F.array_join(c, "|") if k.startswith("refs") else c).alias(k) for k, c in screening.markup("source", "target").items()])


_SENTENCES = "len(regexp_extract_all({0}, '[.!?…。！？؟۔]+([\\s\\p{{Z}}]|$)'))"


@query(f"with {PAIRS} select conv_id % 16 as chapter, round_even(avg({_SENTENCES.format('target')} - {_SENTENCES.format('source')}), 2) as mean_delta, count(*) as pairs from pairs group by 1")
def sentence_delta_by_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import reporting

    rows = pairs(spark, sf_dir).withColumn("chapter", F.col("conv_id") % 16)
    return reporting.sentence_deltas(rows, "chapter", tx.n_sentences("target") - tx.n_sentences("source"))


def findings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All screens at once as the long findings table."""
    rows = pairs(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("segment_id"), "source", F.when(F.col("conv_id") % 9 == 0, F.lit("")).when(F.col("conv_id") % 9 == 1, F.col("source")).otherwise(F.col("target")).alias("target"))
    return screening.findings(rows)


query()(findings_long)

#: A glossary over the driver's invented words.
TERMS = (("the", "der", "other"), ("That", "dass", "character"), ("of", "von den", "place"), ("license", "Lizenz", "other"), ("Éla", "Ela", "character"), ("zzz", "nichts", "title"))
TERMS_SQL = "terms(source, target, kind) as (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TERMS) + ")"


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TERMS), "source string, target string, kind string")


#: Whole-word hits, RE2 without look-around: a word ends before a doubled separator.
_HITS = "len(regexp_extract_all(' ' || regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') || ' ', '(?i)[^\\p{L}\\p{N}_]' || t.source || '[^\\p{L}\\p{N}_]'))"
_OCC = f"occ as (select t.source, t.target, t.kind, sum({_HITS})::bigint as occurrences from documents d, terms t group by 1, 2, 3)"


@query(f"with {TERMS_SQL}, {_OCC} select source, occurrences from occ")
def glossary_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.occurrences(_terms(spark), table(spark, sf_dir, "documents")).select("source", "occurrences")


@query(f"with {TERMS_SQL}, {_OCC} select source, occurrences from occ where occurrences >= 3 or kind in ('character', 'place')")
def glossary_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.kept(glossary.occurrences(_terms(spark), table(spark, sf_dir, "documents"))).select("source", "occurrences")


@query(f"with {TERMS_SQL}, {_OCC}, e(source, target, kind, occurrences) as (values ('of', 'aus', 'other', 0::bigint), ('new', 'neu', 'other', 1::bigint)) select * from e union all select source, target, kind, occurrences from occ where occurrences >= 3 and source not in (select source from e)")
def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.createDataFrame([("of", "aus", "other", 0), ("new", "neu", "other", 1)], "source string, target string, kind string, occurrences long")
    new = glossary.occurrences(_terms(spark), table(spark, sf_dir, "documents")).where("occurrences >= 3").select("source", "target", "kind", "occurrences")
    return glossary.merged(old, new)


@query(f"""with {PAIRS}, {TERMS_SQL}, o as (select p.conv_id, p.turn, t.source as term, t.target as wanted, p.target as text from pairs p, terms t where {_HITS.replace('text', 'p.source')} > 0),
w as (select *, case when len(c) > 0 then c else a end as needed from (select *, regexp_extract_all(wanted, '[\\p{{L}}]+') as a, list_filter(regexp_extract_all(wanted, '[\\p{{L}}]+'), lambda x: length(x) > 3) as c from o))
select conv_id, turn, term, len(list_filter(needed, lambda x: not contains(lower(text), case when length(x) <= 4 then lower(x) else substr(lower(x), 1, greatest(4, floor(length(x) * 0.7::double))::int) end))) = 0 as adherent from w""")
def glossary_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("conv_id", "turn", F.col("source").alias("source_text"), F.col("target").alias("target_text"))
    return glossary.occurring(rows, _terms(spark)).select("conv_id", "turn", F.col("source").alias("term"), glossary.adheres("target", "target_text").alias("adherent"))


def glossary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renderings of each term and whether they are consistent (a map of lists, rows only)."""
    rows = pairs(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("source").alias("source_text"), F.col("target").alias("target_text"))
    found = glossary.audit(rows, _terms(spark))
    return found.select("source", F.size("renderings").alias("n_renderings"), "consistent")


query()(glossary_audit)


@query(f"""with {LINES}, l as (select *, {TOKENS} as tokens, row_number() over w - 1 as rn, sum({TOKENS}) over w as upto, count(*) over (partition by book_id) as n from lines where length(text) > 120 window w as (partition by book_id order by doc_id, pos)),
s as (select book_id, rn as start, upto - tokens as base, rn // greatest(1, n // 10) as passage from l where rn % greatest(1, n // 10) = 0 and rn < greatest(1, n // 10) * 10)
select l.book_id, passage::bigint as passage, array_to_string(list(text order by rn), chr(10) || chr(10)) as text from l join s on l.book_id = s.book_id and rn >= start and (upto - base <= 1200 or rn = start) group by 1, 2""")
def passage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenting.passages(lines(spark, sf_dir))




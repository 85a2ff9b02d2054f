"""Queries of text projections, cleaning and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import cleaning, ranges, segmenting, structure
from ..sources import readers
from .registry import LINES, STRIPPED, TOKENS, lines, query, table

#: Signs that the driver's texts lack, put before them on both sides.
INJECTED = "ﬁne oﬃce ​word  été soft­hyphen thin  "
_LIGATED = "text"
for _a, _b in tx.LIGATURES.items():
    _LIGATED = f"replace({_LIGATED}, '{_a}', '{_b}')"
NORMALIZED = f"regexp_replace(translate({_LIGATED}, '{tx.SPACES}{tx.DELETED}', '     '), '[ \\t]{{2,}}', ' ', 'g')"
_EDGE = "[^\\p{L}\\p{N}_]"
_MASKED = f"regexp_replace(lower(regexp_replace({NORMALIZED}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '\\p{{Nd}}+', '#', 'g')"
_ROMAN = f"regexp_replace(regexp_replace({_MASKED}, '(^|{_EDGE})[ivxlcdm]+($|{_EDGE})', '\\1#\\2', 'g'), '(^|{_EDGE})[ivxlcdm]+($|{_EDGE})', '\\1#\\2', 'g')"
KEY = f"trim(regexp_replace({_ROMAN}, '[^\\p{{L}}\\p{{N}}_#]+', ' ', 'g'))"
_PAGE = tx.PAGE_NUMBER.replace("'", "''")
IS_PAGE = f"(length({STRIPPED}) between 1 and 20 and regexp_matches({STRIPPED}, '{_PAGE}'))"
_CHAPTER = " or ".join(f"regexp_matches({STRIPPED}, '{p}')" for p in tx.CHAPTERS)
_QUOTE = " or ".join("starts_with({0}, '{1}')".format(STRIPPED, q.replace("'", "''")) for q in tx.QUOTES)
OPEN = f"(length({STRIPPED}) <= 90 and not regexp_matches({STRIPPED}, '[.!?;]$'))"
KIND = f"case when length({STRIPPED}) <= 20 and regexp_matches({STRIPPED}, '{tx.SCENE_BREAK}') then 'scene_break' when regexp_matches({STRIPPED}, '{tx.CAPTION}') then 'figure_caption' when regexp_matches({STRIPPED}, '{tx.LIST_ITEM}') then 'list_item' when length({STRIPPED}) <= 80 and ({_CHAPTER}) and {OPEN} then 'heading' when {_QUOTE} then 'dialogue' else 'paragraph' end"


def _count(pattern: str, of: str = "text") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


@query(f"select doc_id, nfc_normalize({NORMALIZED}) as text from (select doc_id, '{INJECTED}' || text as text from documents)")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(INJECTED), "text").alias("text"))
    return docs.select("doc_id", tx.normalize_nfc("text").alias("text"))


@query(f"with {LINES} select book_id, {KEY} as key, count(*) as hits from lines group by 1, 2")
def furniture_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("book_id", tx.furniture_key("text").alias("key")).agg(F.count(F.lit(1)).alias("hits"))


@query(f"with {LINES}, keyed as (select book_id, doc_id, {KEY} as key from lines), pages as (select book_id, count(distinct doc_id) as pages from lines group by 1) select book_id, key, count(distinct doc_id) as n_pages, count(*) as hits from keyed join pages using (book_id) where key <> '' and length(key) <= 120 and pages >= 4 group by book_id, key, pages having count(distinct doc_id) >= greatest(2, floor(pages * 0.05::double))")
def running_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    from ..settings import DEFAULTS

    groups = cleaning.furniture_groups(lines(spark, sf_dir), page="doc_id", s=replace(DEFAULTS, furniture_page_share=0.05))
    return groups.where("n_pages >= threshold").select("book_id", "key", "n_pages", "hits")


@query(f"with {LINES} select doc_id, pos, text from lines where {IS_PAGE} union all select doc_id, -1::int, text from (select doc_id, '- ' || doc_id || ' -' as text from documents) where {IS_PAGE}")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "pos", "text")
    numbered = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("pos"), F.concat(F.lit("- "), "doc_id", F.lit(" -")).alias("text"))
    return rows.unionByName(numbered).where(tx.is_page_number("text"))


_SCRIPT_COUNTS = ", ".join(_count(f"\\p{{{p}}}") + f" as {name}" for name, p in tx.SCRIPTS)
_TOP = f"greatest({', '.join(name for name, _ in tx.SCRIPTS)})"
_SCRIPT = f"case when {_TOP} = 0 then 'unknown' {' '.join(f'when {name} = {_TOP} then {chr(39)}{name}{chr(39)}' for name, _ in tx.SCRIPTS)} end"


@query(f"select doc_id, {_SCRIPT} as script from (select doc_id, {_SCRIPT_COUNTS} from documents)")
def script_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.dominant_script("text").alias("script"))


@query(f"""with s as (select doc_id, text, length(text)::double as n, {_SCRIPT} as script from (select doc_id, text, {_SCRIPT_COUNTS} from documents)),
r as (select doc_id, n, script, {_count('[\\x{FFFD}\\x00]')} / n as replacement_ratio,
 {_count('[\\p{Cc}\\p{Cf}\\p{Co}]')} / n - {_count('[\\t\\n\\x0B\\f\\r\\x{85}]')} / n as control_ratio,
 {_count('[^\\p{L}\\p{N}\\s\\x0B\\x{85}\\p{Z}.,;:!?' + chr(39) * 2 + '"—–()\\[\\]-]')} / n as nonword_ratio,
 case when script in ('latin', 'cyrillic', 'greek') then {_count('[\\s\\x0B\\x{85}\\p{Z}]')} / n end as space_ratio,
 case when script in ('latin', 'cyrillic', 'greek') then {_count('[' + tx.VOWELS + ']', 'lower(text)')}::double / {_count('\\p{L}', 'lower(text)')} end as vowel_ratio from s)
select doc_id, replacement_ratio, nonword_ratio, space_ratio, vowel_ratio, case when replacement_ratio > 0.02 or control_ratio > 0.02 or nonword_ratio > 0.35 then 'garbled' when script not in ('latin', 'cyrillic', 'greek') then 'unknown'
 when space_ratio between 0.08 and 0.30 and vowel_ratio between 0.25 and 0.60 then 'clean' when space_ratio between 0.08 and 0.30 or vowel_ratio between 0.25 and 0.60 then 'suspect' else 'garbled' end as verdict from r""")
def garble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("script", tx.dominant_script("text"))
    g = tx.garbling("text", F.col("script"))
    return docs.select("doc_id", *[g[k].alias(k) for k in ("replacement_ratio", "nonword_ratio", "space_ratio", "vowel_ratio", "verdict")])


#: Common short words of four languages, for guessing; ties go to the first.
STOPWORDS = (("en", ("the", "and", "of", "to", "is", "that")), ("fr", ("le", "la", "les", "et", "des", "que")), ("de", ("der", "die", "das", "und", "von", "ist")), ("es", ("el", "los", "las", "que", "del", "una")))


def _stop(words: tuple[str, ...], of: str) -> str:
    return _count(f"(^|[ \\n])({'|'.join(words)})($|[ \\n.,])", of)


_GUESS = f"select doc_id, lang, case when greatest(en, fr, de, es) = 0 then null when en = greatest(en, fr, de, es) then 'en' when fr = greatest(en, fr, de, es) then 'fr' when de = greatest(en, fr, de, es) then 'de' else 'es' end as guess from (select doc_id, lang, {', '.join(_stop(w, 'lower(text)') + f' as {k}' for k, w in STOPWORDS)} from documents where length(trim(text)) >= 20)"


def _guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) >= 20)
    counts = [F.regexp_count(F.lower("text"), F.lit(f"(^|[ \\n])({'|'.join(w)})($|[ \\n.,])")).alias(k) for k, w in STOPWORDS]
    top = F.greatest(*[F.col(k) for k, _ in STOPWORDS])
    guess = F.lit("es")
    for k in ("de", "fr", "en"):
        guess = F.when(F.col(k) == top, k).otherwise(guess)
    return docs.select("doc_id", "lang", *counts).select("doc_id", "lang", F.when(top > 0, guess).alias("guess"))


@query(f"select doc_id, guess from ({_GUESS})")
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guess(spark, sf_dir).select("doc_id", "guess")


@query(f"select lang, guess, count(*) as n from ({_GUESS}) group by 1, 2")
def language_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guess(spark, sf_dir).groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, {TOKENS} as tokens from documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.n_tokens("text").alias("tokens"))


@query(f"select doc_id, {_count('[^\\s\\x0B\\x{85}\\p{Z}]+')}::int as words from documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.n_words("text").alias("words"))


@query(f"with {LINES} select doc_id, pos, text from lines")
def block_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", "text")


@query(f"with {LINES} select doc_id, pos, printf('b%04d', row_number() over (partition by book_id order by doc_id, pos) - 1) as id from lines")
def block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ranges.numbered(lines(spark, sf_dir).select("book_id", "doc_id", "pos"), ["book_id"], ["doc_id", "pos"], "at")
    return placed.select("doc_id", "pos", tx.block_id(F.col("at") - 1).alias("id"))


#: One line a document of a kind that the driver's texts lack.
_LACKING = ("* * *", "Figure 3 shows", "• item one", "Chapter IV", "“Quoted,” it said.", "Part 2", "12", "Chapter 4 ended here.", "--- --- ---", "(a) first")


@query(f"with {LINES}, more as (select text from lines union all select {list(_LACKING)}[(doc_id % 10 + 1)::int] as text from documents) select {KIND} as kind, count(*) as n from more group by 1")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.element_at(F.array(*[F.lit(x) for x in _LACKING]), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = lines(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "documents").select(some.alias("text")))
    return rows.groupBy(structure.kind_by_text("text").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


#: Pages as Markdown: headings, list items as quotations, a break before the footer.
_MD = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*</head>', '', 'g'), '<h1>', chr(10) || '# ', 'g'), '<li>', chr(10) || '> ', 'g'), '<p>|<footer>', chr(10), 'g'), '<article>', chr(10) || '---' || chr(10), 'g')"


@query(f"""with md as (select page_id as book_id, regexp_replace({_MD}, '<[^>]*>', '', 'g') as text from pages),
raw as (select book_id, generate_subscripts(ls, 1) - 1 as ord, unnest(ls) as line from (select book_id, string_split(text, chr(10)) as ls from md)),
t as (select book_id, ord, regexp_replace(line, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as t from raw),
k as (select *, regexp_matches(t, '^(\\{{[0-9]+\\}}|-{{3,}})$') as is_break, length(regexp_extract(t, '^(#{{1,6}})\\s+(.*)$', 1)) as level from t where t <> ''),
b as (select *, case when is_break and not coalesce(lag(is_break) over (partition by book_id order by ord), true) then 1 else 0 end as ends from k),
p as (select *, (1 + sum(ends) over (partition by book_id order by ord))::int as page from b)
select book_id, page, (row_number() over (partition by book_id, page order by ord) - 1)::int as line_ord,
 case when level > 0 then trim(regexp_extract(t, '^(#{{1,6}})\\s+(.*)$', 2)) when starts_with(t, '>') then trim(regexp_replace(t, '^[> ]+', '')) else t end as text,
 (case level when 1 then 20 when 2 then 17 when 3 then 15 when 4 then 13 when 5 then 12 when 6 then 11 else 10 end)::double as size,
 (case when starts_with(t, '>') and level = 0 then 75 else 45 end)::double as x0 from p where not is_break""")
def markdown_lines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.regexp_replace("html", "(?s)<head>.*</head>", "")
    for a, b in (("<h1>", "\n# "), ("<li>", "\n> "), ("<p>|<footer>", "\n"), ("<article>", "\n---\n"), ("<[^>]*>", "")):
        body = F.regexp_replace(body, a, b)
    books = table(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), body.alias("text"))
    return readers.markdown_lines(books).select("book_id", "page", "line_ord", "text", "size", "x0")


#: Words of eight letters or more, broken after four with a line end.
_BROKEN = "regexp_replace(text, '([\\p{L}]{4})([\\p{L}]{4,})', '\\1-' || chr(1) || '\\2', 'g')"
_FORMS = "regexp_extract_all(lower({0}), '[\\p{{L}}]+(?:-[\\p{{L}}]+)*')"
HYPHENS = f"""w as (select source as book_id, doc_id, {_BROKEN} as text from documents),
forms as (select book_id, word, count(*) as n from (select book_id, unnest(list_concat({_FORMS.format("replace(replace(text, '-' || chr(1), ''), chr(1), '')")}, {_FORMS.format("replace(text, chr(1), '')")})) as word from w) group by 1, 2),
parts as (select book_id, doc_id, string_split(text, chr(1)) as p from w),
c as (select book_id, doc_id, k, lower(regexp_extract(p[k], '([\\p{{L}}]+)-$', 1)) as l, lower(regexp_extract(p[k + 1], '^([\\p{{L}}]+)', 1)) as r from (select *, unnest(range(1, len(p))) as k from parts)),
decided as (select c.book_id, c.doc_id, c.k, l || r as joined, coalesce(a.n, 0) as joined_count, coalesce(b.n, 0) as hyphen_count, coalesce(a.n, 0) >= coalesce(b.n, 0) as join_it from c left join forms a on a.book_id = c.book_id and a.word = l || r left join forms b on b.book_id = c.book_id and b.word = l || '-' || r where l <> '' and r <> '')"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("book_id"), "doc_id", F.regexp_replace("text", "([\\p{L}]{4})([\\p{L}]{4,})", "$1-" + cleaning.BREAK + "$2").alias("text"))


@query(f"with {HYPHENS} select book_id, doc_id, k::int as k, joined, joined_count, hyphen_count, join_it from decided")
def dehyphenate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleaning.hyphen_decisions(_broken(spark, sf_dir), "book_id", "doc_id")
    return found.select("book_id", "doc_id", F.col("k").cast("int").alias("k"), "joined", "joined_count", "hyphen_count", F.col("join").alias("join_it"))


@query(f"""with {HYPHENS}, picks as (select doc_id, list(k) as ks from decided where join_it group by 1)
select w.doc_id, array_to_string(list_transform(range(1, len(string_split(text, chr(1))) + 1), lambda k: case when list_contains(coalesce(ks, []), k) then regexp_replace(string_split(text, chr(1))[k], '-$', '') else string_split(text, chr(1))[k] end), '') as text from w left join picks using (doc_id)""")
def dehyphenated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.dehyphenate(_broken(spark, sf_dir), "book_id", "doc_id").select("doc_id", "text")


@query(f"""with {LINES}, p as (select *, lag(text) over (partition by doc_id order by pos) as before from lines)
select doc_id, sum(case when before is null or regexp_matches(trim(before), '[.!?…"''”’»)』」]$') or not regexp_matches(trim(text), '^\\p{{Ll}}') then 1 else 0 end)::bigint as paragraphs from p group by 1""")
def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines(spark, sf_dir).withColumn("before", F.lag("text").over(w))
    starts = F.col("before").isNull() | cleaning.terminal("before") | ~F.trim("text").rlike("^\\p{Ll}")
    return rows.groupBy("doc_id").agg(F.count_if(starts).alias("paragraphs"))


def _matter_sql(first: str) -> str:
    tags = " ".join(f"when regexp_matches({STRIPPED}, '{p.replace('(?iU)', '(?i)').replace(chr(39), chr(39) * 2)}') then '{k}'" for k, p in structure.MATTER)
    return f"""with {LINES.replace("string_split(text, chr(10))", "string_split(case when doc_id % 7 = 0 then 'Contents' || chr(10) || text else text end, chr(10))")},
k as (select *, {KIND} as kind, case {tags} end as tag, pos as place from lines),
e as (select *, case when tag = 'toc' then true when tag is null and (kind = 'heading' or place >= {first}) then false end as event from k),
s as (select *, coalesce(last_value(event ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row), false) as sticky from e)
select case when tag is not null then tag when sticky then 'toc' when place < {first} and place < 3 then 'cover' else 'body' end as matter, count(*) as n from s group by 1"""


def _matter(spark: SparkSession, sf_dir: str, first: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Contents\n"), "text")).otherwise(F.col("text")))
    rows = segmenting.line_blocks(docs).withColumn("kind", structure.kind_by_text("text"))
    return structure.matter(rows, first, book="doc_id", order="pos", place="pos").groupBy("matter").agg(F.count(F.lit(1)).alias("n"))


@query(_matter_sql("5"))
def toc_sticky_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matter(spark, sf_dir, 5)


@query(_matter_sql("0"))
def matter_as_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matter(spark, sf_dir, 0)


@query(f"""with recursive {LINES}, h as (select book_id, doc_id * 10000 + pos as ordinal, (10 + length(text) % 7)::double as size from lines where length(text) <= 20),
z as (select book_id, size, least(row_number() over (partition by book_id order by size desc), 6) as r from (select distinct book_id, size from h)),
o as (select h.book_id, ordinal, r, row_number() over (partition by h.book_id order by ordinal) as k from h join z on z.book_id = h.book_id and z.size = h.size),
f as (select book_id, ordinal, k, r::int as level from o where k = 1 union all select o.book_id, o.ordinal, o.k, least(o.r, f.level + 1)::int from f join o on o.book_id = f.book_id and o.k = f.k + 1)
select book_id, ordinal, level from f""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).where(F.length("text") <= 20).select("book_id", (F.col("doc_id") * 10000 + F.col("pos")).alias("ordinal"), (10 + F.length("text") % 7).cast("double").alias("size"))
    return structure.heading_levels(rows)


@query(f"with {LINES} select doc_id, pos, sum(case when length(text) <= 20 then 1 else 0 end) over (partition by book_id order by doc_id, pos)::int as chapter from lines")
def chapter_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chapters_of(lines(spark, sf_dir), F.length("text") <= 20, order=("doc_id", "pos")).select("doc_id", "pos", "chapter")


@query("""with c as (select source as book_id, doc_id as start_page, 'ch' || doc_id as chapter_id from documents where doc_id % 3 = 1), n as (select source as book_id, doc_id as page from documents where doc_id % 3 <> 1)
select n.book_id, n.page, coalesce((select arg_max(chapter_id, start_page) from c where c.book_id = n.book_id and c.start_page <= n.page), (select arg_min(chapter_id, start_page) from c where c.book_id = n.book_id)) as chapter_id from n""")
def footnote_chapter_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page"))
    chapters = docs.where("page % 3 = 1").select("book_id", F.col("page").alias("start_page"), F.concat(F.lit("ch"), "page").alias("chapter_id"))
    return structure.chapter_asof(docs.where("page % 3 <> 1"), chapters).select("book_id", "page", "chapter_id")


@query(f"""with w as (select source as book_id, doc_id, {_count('[^\\s\\x0B\\x{85}\\p{Z}]+')}::int as words from documents), m as (select *, quantile_cont(words, 0.5) over (partition by book_id) as median from w)
select doc_id, words, case when words = 0 then 'empty' when words < 200 then 'short' when words > 3 * median then 'long' end as anomaly from m""")
def chapter_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", tx.n_words("text").alias("words"))
    return structure.anomalies(rows).select("doc_id", "words", "anomaly")


@query("""select doc_id, case when d <> '' then d::int when w <> '' then list_position(['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen','twenty'], w)::int when r <> '' then 10 * (r = 'x')::int + 4 * (r = 'iv')::int + 9 * (r = 'ix')::int + 40 * (r = 'xl')::int end as number
from (select doc_id, case when doc_id % 3 = 0 then (doc_id % 1000)::varchar else '' end as d, case when doc_id % 3 = 1 then ['one','seven','twelve','twenty'][(doc_id % 4 + 1)::int] else '' end as w, case when doc_id % 3 = 2 then ['iv','ix','x','xl'][(doc_id % 4 + 1)::int] else '' end as r from documents)""")
def chapter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *w: F.element_at(F.array(*[F.lit(x) for x in w]), (F.col("doc_id") % 4 + 1).cast("int"))
    title = F.concat(F.lit("Chapter "), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 1000).cast("string")).when(F.col("doc_id") % 3 == 1, pick("one", "Seven", "twelve", "twenty")).otherwise(pick("IV", "ix", "X", "xl")))
    return table(spark, sf_dir, "documents").select("doc_id", tx.chapter_number(title).alias("number"))


@query("select doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) as slug, sha256(text) as sha, case when length(w) <= 4 then w else substr(w, 1, greatest(4, floor(length(w) * 0.7::double))::int) end as stem from (select doc_id, text, lower(regexp_extract(text, '[\\p{L}]+')) as w from documents)")
def slugs_and_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.slug("text").alias("slug"), F.sha2("text", 256).alias("sha"), tx.stem_prefix(F.regexp_extract("text", "[\\p{L}]+", 0)).alias("stem"))


@query("with b as (select source, count(*) as n from documents group by 1), s as (select source, n, floor(n * 0.1::double)::int as start from b) select source, unnest(list_sort(list_distinct(list_transform(range(1, least(3, n) + 1), lambda i: least(start + floor((n - start) * i / (least(3, n) + 1)::double)::int, n - 1) + 1)))) as page from s")
def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return books.select("source", F.explode(tx.sampled_pages(F.col("n")).cast("array<long>")).alias("page"))


@query("""with p as (select source as book_id, doc_id as page, case when doc_id % 17 = 0 then substr(text, 1, 20) else text end as text from documents),
r as (select *, length(text) as n, row_number() over (partition by book_id order by length(text), page) as r, count(*) over (partition by book_id) as c from p),
m as (select *, max(case when r = c // 2 + 1 then n end) over (partition by book_id) as median from r),
s as (select book_id, page, case when n < greatest(0.15::double * median, 40) then 1 - n::double / median end as badness from m),
k as (select *, row_number() over (partition by book_id order by badness desc, page) as k from s where badness is not null)
select book_id, page, badness from k where k <= 5""")
def pages_to_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 17 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("text"))
    return readers.pages_to_reread(pages, 5)


@query("""with l as (select source as book_id, doc_id, regexp_replace(text, '(.{1,60})( |$)', '\\1' || chr(10), 'g') as text from documents),
r as (select doc_id as book_id, (generate_subscripts(ls, 1) - 1)::int as line_ord, unnest(ls) as raw from (select doc_id, string_split(text, chr(10)) as ls from l))
select book_id, 1 as page, line_ord, trim(raw, ' ') as text, ((length(raw) - length(ltrim(raw, ' '))) * 5)::double as x0, (line_ord * 12)::double as top from r where trim(raw, ' ') <> ''""")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.regexp_replace("text", "(.{1,60})( |$)", "$1\n").alias("text"))
    return readers.layout_lines(books).select("book_id", "page", "line_ord", "text", "x0", "top")

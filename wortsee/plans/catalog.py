"""Queries over the test tables, one or more for each operator, with the SQL that they are checked against."""

from __future__ import annotations

import io
import zipfile
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import chapters as ch
from ..operators import checkpoint as cp
from ..operators import extract as ex
from ..operators import known as kn
from ..operators import sentences as se
from ..operators import validation as va
from ..operators import wordlist as wl
from ..sources import artifacts as art
from ..sources import audio, epub
from ..sources.epub import is_epub

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def delivered_once(df: DataFrame, key: list[str], *cols: str) -> DataFrame:
    """Redelivered rows have the same content, so any of them will do; combined map-side."""
    return df.groupBy(*key).agg(*[F.first(c).alias(c) for c in cols])


# DuckDB writes code points in classes as \x{..} too.
WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_squeeze = lambda c: f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"
_strip = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
_fold = lambda c: f"replace(lower({c}), 'ß', 'ss')"
_norm = lambda c: _fold(_squeeze(c))
_SW = "sw as (select sw_id, any_value(source_id) source_id, any_value(text) text, any_value(count) count, any_value(words) words from sentence_words where sw_id is not null group by sw_id)"
_WORDS = f"{_SW}, w as (select sw_id, source_id, text, count, u.i - 1 w_ord, words[u.i].lemma lemma, words[u.i].word_type word_type, words[u.i].article article from sw, unnest(range(1, len(words) + 1)) u(i))"
_CARDS = "cards as (select card_id, any_value(deck_id) deck_id, any_value(entry) entry from known_words where card_id is not null group by card_id)"
_KEYS = f"""{_CARDS}, ents as (select distinct {_norm('entry')} entry from cards),
pieces as (select entry, unnest(string_split(entry, ',')) p from ents where entry <> ''),
bracket as (select entry, unnest([regexp_replace(p, '{WS}*\\([^)]*\\)', '', 'g'), translate(p, '()', '')]) p from pieces),
toks as (select entry, list_transform(list_filter(string_split({_squeeze('p')}, ' '), lambda t: t <> ''), lambda t: string_split(t, '/')) alts from bracket),
phrases as (select entry, unnest(case when len(alts) = 0 then [''] else list_reduce(alts, lambda a, b: flatten(list_transform(a, lambda x: list_transform(b, lambda y: x || ' ' || y)))) end) p from toks),
words_of as (select entry, list_filter(string_split({_squeeze('p')}, ' '), lambda t: t <> '') ws from phrases),
plain as (select entry, ws, list_transform(ws, lambda t: coalesce(nullif(regexp_replace(t, '[-.]+$', ''), ''), t)) pl from words_of),
bare as (select entry, unnest([ws, pl, list_filter(ws, lambda t: t <> 'sich'), list_filter(pl, lambda t: t <> 'sich')]) f, unnest([false, false, true, true]) cutting from plain),
forms as (select entry, array_to_string(case when cutting and len(f) > 1 and f[1] in ('der', 'die', 'das', 'ein', 'eine') then f[2:] else f end, ' ') key from bare),
keys as (select distinct entry, key from forms where key <> '')"""


def sentence_words_once(spark, d) -> DataFrame:
    return delivered_once(read(spark, d, "sentence_words").where("sw_id is not null"), ["sw_id"], "source_id", "text", "count", "words")


def words_once(spark, d) -> DataFrame:
    return wl.explode_words(sentence_words_once(spark, d), ["source_id"], ord_="sw_id")


def cards_once(spark, d) -> DataFrame:
    return delivered_once(read(spark, d, "known_words").where("card_id is not null"), ["card_id"], "deck_id", "entry")


def known_keys(spark, d) -> DataFrame:
    return kn.keys(kn.entries(cards_once(spark, d), "entry"))


def _list_sql(having: str, group: str = "source_id, ", extra: str = "") -> str:
    return f"""with {_WORDS}, {_KEYS},
u as (select *, {_fold('lemma')} lemma_key from w where lemma is not null and not exists (select 1 from keys where key = {_norm('lemma')})),
a as (select {group}lemma_key, word_type, arg_min(lemma, row(sw_id, w_ord)) lemma, arg_min(article, row(sw_id, w_ord)) filter (where article is not null) article, cast(coalesce(sum(count), 0) as bigint) count,
 count(distinct text) n_sentences from u group by {'1, 2, 3' if group else '1, 2'}) select * from a {having}"""


@query(_list_sql("where count >= 1"))
def word_list(spark, d):
    """Known words leave, the rest is counted by source, lemma and type (examples only as their number)."""
    made = wl.build(words_once(spark, d), ["source_id"], known_keys(spark, d), examples="count")
    return made.select("source_id", "lemma_key", "word_type", "lemma", "article", "count", "n_sentences")


@query(_list_sql("where count >= 5", group=""))
def min_count(spark, d):
    """The list of the whole collection, words seen five times or more."""
    w = words_once(spark, d).withColumnRenamed("s_ord", "_s").withColumn("s_ord", F.col("_s"))
    made = wl.build(w, [], known_keys(spark, d), min_count=5, examples="count")
    return made.select("lemma_key", "word_type", "lemma", "article", "count", "n_sentences")


@query(f"with {_WORDS}, a as (select {_fold('lemma')} lemma_key, word_type from w where lemma is not null group by 1, 2 having sum(count) >= 1) select lemma_key, count(distinct word_type) n_types from a group by 1 having count(distinct word_type) > 1")
def homonyms(spark, d):
    built = wl.build(words_once(spark, d), [], examples=None)
    return built.groupBy("lemma_key").agg(F.countDistinct("word_type").alias("n_types")).where("n_types > 1")


@query(f"with {_WORDS} select source_id, {_fold('lemma')} lemma_key, word_type, arg_min(article, row(sw_id, w_ord)) filter (where article is not null) article from w where lemma is not null group by 1, 2, 3 having sum(count) >= 1")
def first_article(spark, d):
    return wl.build(words_once(spark, d), ["source_id"], examples=None).select("source_id", "lemma_key", "word_type", "article")


@query(f"""with {_WORDS}, t as (select source_id, {_fold('lemma')} lemma_key, word_type, text, min(row(sw_id, w_ord)) o, sum(count) n from w where lemma is not null group by 1, 2, 3, 4)
select source_id, lemma_key, word_type, string_agg(text, ' | ' order by o) examples from t group by 1, 2, 3 having sum(n) >= 1""")
def example_sentences(spark, d):
    made = wl.build(words_once(spark, d), ["source_id"])
    return made.select("source_id", "lemma_key", "word_type", F.nullif(F.array_join("sentences", " | "), F.lit("")).alias("examples"))


@query(f"select source_id, pos, {_squeeze('text')} text from (select source_id, pos, any_value(text) text from sentences group by all)")
def ws_normalize(spark, d):
    s = delivered_once(read(spark, d, "sentences"), ["source_id", "pos"], "text")
    return s.select("source_id", "pos", tx.collapse_ws(F.col("text")).alias("text"))


@query(f"with {_CARDS} select card_id, {_norm('entry')} entry from cards")
def casefold_key(spark, d):
    return cards_once(spark, d).select("card_id", tx.normalize_word(F.col("entry")).alias("entry"))


@query(f"""with s as (select source_id, seg_id, any_value(text) text from segments group by all), t as (select source_id, seg_id, {_strip('text')} t from s)
select source_id, coalesce(string_agg(t, ' ' order by seg_id) filter (where t <> ''), '') text from t group by 1""")
def join_segments(spark, d):
    s = delivered_once(read(spark, d, "segments"), ["source_id", "seg_id"], "text")
    return se.join_segments(s, ["source_id"], "seg_id", "text")


_ABBR = r"(z\.\s?B|d\.\s?h|u\.\s?a|u\.\s?Ä|o\.\s?ä|i\.\s?d|s\.\s?o|s\.\s?u|v\.\s?a|Dr|Prof|Hr|Fr|St|Nr|Bd|Kap|Abb|Tab|S|usw|bzw|ca|etc|evtl|ggf|inkl|vgl|mind|max|Mr|Mrs|Ms|Jan|Febr|Aug|Sept|Okt|Nov|Dez)"
_shield = lambda c: rf"regexp_replace({c}, '(^|[^\p{{L}}]){_ABBR}\.(\s)', '\1\2' || chr(1) || '\3', 'g')"
_initial = lambda c: rf"regexp_replace({c}, '(^|[^\p{{L}}])([a-zäöü])\.(\s)', '\1\2' || chr(1) || '\3', 'g')"
_split_sql = lambda c: rf"""list_filter(list_transform(string_split(regexp_replace({_initial(_initial(_shield(_shield(_squeeze(c)))))}, '([.!?…]["''»«“”’)]{{0,3}})\s+(["''„»«“‚(]*[\p{{Lu}}\p{{Nd}}])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda p: trim(replace(p, chr(1), '.'))), lambda p: p <> '')"""


@query(f"with s as (select doc_id, {_split_sql('text')} ss from documents where text is not null) select doc_id, u.i - 1 pos, ss[u.i] text from s, unnest(range(1, len(ss) + 1)) u(i)")
def sentence_split(spark, d):
    """The rule profile before ordinals are mended, over all documents."""
    docs = read(spark, d, "documents").where("text is not null")
    return se.explode_sentences(docs, ["doc_id"], se.rule_split(F.col("text"))).withColumn("pos", F.col("pos").cast("long"))


@query(r"""with s as (select source_id, pos, any_value(text) text from sentences group by all),
b as (select *, case when regexp_matches(lag(text) over w, '(^|[\s\x{85}\x{A0}\x{2028}\x{2029}])\p{Nd}{1,2}\.$') then 0 else 1 end b from s window w as (partition by source_id order by pos)),
c as (select *, sum(b) over (partition by source_id order by pos) chain from b)
select source_id, min(pos) pos, string_agg(text, ' ' order by pos) text from c group by source_id, chain""")
def ordinal_merge(spark, d):
    s = delivered_once(read(spark, d, "sentences"), ["source_id", "pos"], "text")
    return se.merge_ordinals(s, ["source_id"], "pos", "text")


@query("select source_id, text, count(*) count, min(pos) ord from (select source_id, pos, any_value(text) text from sentences group by all) where text is not null group by source_id, text")
def distinct_sentences(spark, d):
    s = delivered_once(read(spark, d, "sentences"), ["source_id", "pos"], "text")
    return se.distinct_sentences(s, ["source_id"], "pos", "text")


@query(f"""with {_WORDS}, k as (select sw_id, w_ord, {_squeeze('lemma')} lemma, word_type, article from w)
select sw_id, cast(w_ord as int) w_ord, lemma, word_type, article from (select *, row_number() over (partition by sw_id, {_fold('lemma')}, word_type order by w_ord) n from k) where n = 1""")
def sentence_word_dedup(spark, d):
    w = wl.explode_words(sentence_words_once(spark, d), ["sw_id"], ord_="sw_id").drop("s_ord")
    return wl.dedup_words(w, ["sw_id"]).select("sw_id", "w_ord", "lemma", "word_type", "article")


@query(f"with {_CARDS} select card_id, nullif(entry, '') word from cards where entry is not null")
def known_shapes(spark, d):
    """Each card's entry as an answer in one of the accepted shapes, read back."""
    c = cards_once(spark, d).where("entry is not null")
    e = F.to_json(F.array("entry"))
    item = F.regexp_replace(e, r"^\[|\]$", "")
    body = F.element_at(F.array(e, F.concat(F.lit('{"words":'), e, F.lit("}")), F.concat(F.lit('[{"word":'), item, F.lit("}]")), F.concat(F.lit('[{"word":"","lemma":'), item, F.lit("}]"))), F.pmod("card_id", F.lit(4)).cast("int") + 1)
    return kn.shapes(c.select("card_id", body.alias("body")), "body", ["card_id"]).select("card_id", F.nullif("word", F.lit("")).alias("word"))


@query(f"with {_KEYS} select entry, key from keys")
def match_keys(spark, d):
    return known_keys(spark, d)


@query(f"with {_WORDS}, {_KEYS} select sw_id, cast(w_ord as int) w_ord, lemma from w where lemma is null or not exists (select 1 from keys where key = {_norm('lemma')})")
def anti_known(spark, d):
    w = wl.explode_words(sentence_words_once(spark, d), ["sw_id"], ord_="sw_id")
    return kn.drop_known(w, "lemma", known_keys(spark, d)).select("sw_id", "w_ord", "lemma")


@query()
def html_paragraphs(spark, d):
    c = delivered_once(read(spark, d, "chapters"), ["chapter_id"], "html").where("html is not null")
    return c.select("chapter_id", ch.paragraphs(F.col("html")).alias("p")).select("chapter_id", "p.title", F.posexplode("p.paragraphs").alias("n", "text"))


# The greedy fold over blocks: a state is the parts that are done and the open one, its last element.
_PARTS_SQL = r"""with c as (select chapter_id, any_value(html) html from chapters group by chapter_id),
b as (select chapter_id, html, list_filter(string_split(regexp_replace(html, '<(p|div|h[1-6]|section|article)\b', chr(1) || '<\1', 'gi'), chr(1)), lambda x: x <> '') bs from c where html is not null),
f as (select chapter_id, case when length(html) <= 4000 then [html] else list_filter(list_reduce(bs, lambda st, p: case
 when length(st[-1]) + length(p[1]) <= 4000 then list_append(st[:-2], st[-1] || p[1])
 else list_concat(st, list_transform(range(0, (length(p[1]) - 1) // 4000 + 1), lambda i: substring(p[1], i * 4000 + 1, 4000))) end, ['']), lambda x: x <> '') end parts
 from (select chapter_id, html, list_transform(bs, lambda x: [x]) bs from b))
select chapter_id, u.i - 1 part, parts[u.i] html from f, unnest(range(1, len(parts) + 1)) u(i)"""


@query(_PARTS_SQL)
def html_parts(spark, d):
    """Parts of at most 4 000 code points, cut before blocks."""
    c = delivered_once(read(spark, d, "chapters"), ["chapter_id"], "html").where("html is not null")
    return c.select("chapter_id", F.posexplode(ch.split_markup(F.col("html"), 4000)).alias("part", "html")).withColumn("part", F.col("part").cast("long"))


# Verdicts that stand in for a model's: by the length of the part.
_VERDICTS_SQL = f"""parts as ({_PARTS_SQL}),
v as (select chapter_id, part, case length(html) % 3 when 0 then 'toc' when 1 then 'chapter' else 'other' end kind, length(html) % 3 > 0 is_content, {_split_sql('html')} ss from parts)"""


def _verdicts(spark, d) -> DataFrame:
    """A verdict on each part of each chapter, with the sentences of the part."""
    n = F.length("html") % 3
    kind = F.when(n == 0, "toc").when(n == 1, "chapter").otherwise("other")
    return html_parts(spark, d).select("chapter_id", "part", kind.alias("kind"), (n > 0).alias("is_content"), se.rule_split(F.col("html")).alias("sentences"))


@query(f"""with {_VERDICTS_SQL} select chapter_id, coalesce(arg_min(kind, part) filter (where is_content), arg_min(kind, part)) kind, bool_or(is_content) is_content,
coalesce(array_to_string(flatten(list(ss order by part) filter (where is_content)), ' | '), '') sentences from v group by chapter_id""")
def chapter_verdicts(spark, d):
    """Verdicts on the parts of chapters as one on each chapter."""
    return ch.combine_parts(_verdicts(spark, d), ["chapter_id"]).withColumn("sentences", F.array_join("sentences", " | "))


@query(f"with {_VERDICTS_SQL} select chapter_id, part, cast(u.i - 1 as int) pos, ss[u.i] text from v, unnest(range(1, len(ss) + 1)) u(i) where is_content")
def content_filter(spark, d):
    return ch.content_sentences(_verdicts(spark, d), ["chapter_id", "part"])


@query(f"""with {_VERDICTS_SQL}, c as (select chapter_id, any_value(source_id) source_id, any_value(chapter_index) chapter_index, any_value(title) title from chapters group by chapter_id)
select c.chapter_id, source_id, chapter_index, title, coalesce(arg_min(kind, part) filter (where is_content), arg_min(kind, part)) kind from c join v using (chapter_id) group by 1, 2, 3, 4""")
def judged_chapters(spark, d):
    c = delivered_once(read(spark, d, "chapters"), ["chapter_id"], "source_id", "chapter_index", "title")
    return ch.with_verdicts(c, ch.combine_parts(_verdicts(spark, d), ["chapter_id"]).select("chapter_id", "kind"), ["chapter_id"])


_CLEAN = lambda c: f"regexp_replace(coalesce({c}, ''), '[<>&]', '', 'g')"


@query(f"""with c as (select chapter_id, {_CLEAN('any_value(title)')} t, any_value(href) h, any_value(source_id) s from chapters group by chapter_id)
select chapter_id, nullif({_squeeze('t')}, '') title, cast(case when {_squeeze('t')} = '' then 2 else 3 end as int) n, cast(length({_squeeze('t')}) + length({_squeeze('h')}) + length(s::varchar) as bigint) chars from c""")
def markup_chars(spark, d):
    """Title, number and length of the paragraphs of markup made of title, href and source."""
    c = delivered_once(read(spark, d, "chapters"), ["chapter_id"], "title", "href", "source_id")
    title = F.regexp_replace(F.coalesce("title", F.lit("")), "[<>&]", "")
    html = F.concat(F.lit("<html><head><title>no</title></head><body><H1>"), title, F.lit("&nbsp;</H1><p> <b>"), F.substring("href", 1, 2), F.lit("</b>"), F.expr("substring(href, 3)"), F.lit("<script>x</script><div>"), F.col("source_id").cast("string"), F.lit("</body>"))
    return c.select("chapter_id", ch.paragraphs(html).alias("p")).select("chapter_id", "p.title", F.size("p.paragraphs").alias("n"), ch.char_count(F.col("p.paragraphs")).alias("chars"))


@query("select chapter_id, chapter_index from (select chapter_id, any_value(chapter_index) chapter_index from chapters group by all) where chapter_index = 0 or chapter_index between 2 and 4 or chapter_index = 7")
def chapter_selection(spark, d):
    c = delivered_once(read(spark, d, "chapters"), ["chapter_id"], "chapter_index")
    return c.where(ch.selected(F.col("chapter_index"), "0, 2-4 ,7"))


@query("""with c as (select chapter_id, any_value(source_id) source_id, any_value(chapter_index) chapter_index, any_value(href) href from chapters group by chapter_id)
select chapter_id, cast(row_number() over (partition by source_id order by chapter_index nulls first, chapter_id) - 1 as int) "index" from c where suffix(lower(href), '.xhtml')""")
def spine_numbers(spark, d):
    c = delivered_once(read(spark, d, "chapters"), ["chapter_id"], "source_id", "chapter_index", "href").where(F.lower("href").endswith(".xhtml"))
    return cp.numbered(c, ["source_id"], ["chapter_index", "chapter_id"]).select("chapter_id", "index")


@query("select chapter_id, coalesce(nullif(title, ''), string_split(href, '/')[-1]) title from (select chapter_id, any_value(title) title, any_value(href) href from chapters group by all)")
def title_fallback(spark, d):
    c = delivered_once(read(spark, d, "chapters"), ["chapter_id"], "title", "href")
    return c.select("chapter_id", ch.title_or_name(F.col("title"), F.col("href")).alias("title"))


@query("select source_id, suffix(lower(source_file), '.epub') is_epub from (select source_id, any_value(source_file) source_file from sources group by all)")
def source_kind(spark, d):
    return delivered_once(read(spark, d, "sources"), ["source_id"], "source_file").select("source_id", is_epub(F.col("source_file")).alias("is_epub"))


_LINES = r"""l as (select line_id, any_value(source_id) source_id, any_value(line) line from checkpoint_lines group by line_id),
m as (select *, max(line_id) over (partition by source_id) last, line is null or trim(regexp_replace(line, '[\s\x{85}\x{A0}\x{2028}\x{2029}]', '', 'g')) = '' blank from l),
st as (select *, case when blank then 'blank' when json_valid(line) and json_type(line) = 'OBJECT' then 'record' when line_id = last then 'torn' else 'bad' end status from m)"""


def _lines(spark, d) -> DataFrame:
    lines = delivered_once(read(spark, d, "checkpoint_lines"), ["line_id"], "source_id", "line")
    return cp.parsed_lines(lines, ["source_id"], "line_id", "line")


@query(f"with {_LINES} select line_id, source_id, status from st")
def checkpoint_lines(spark, d):
    return _lines(spark, d).select("line_id", "source_id", "status")


def _answers(spark, d) -> DataFrame:
    return cp.records(_lines(spark, d), "line").where("text is not null")


_ANS = f"{_LINES}, an as (select line_id, source_id, line::json->>'$.text' text, cast(coalesce(json_array_length(line::json, '$.words'), 0) as int) n_words from st where status = 'record')"


@query(f"with {_ANS} select source_id, text, max(line_id) line_id, arg_max(n_words, line_id) n_words from an where text is not null group by source_id, text")
def checkpoint_last_wins(spark, d):
    a = _answers(spark, d).withColumn("n_words", F.coalesce(F.size("words"), F.lit(0))).withColumn("at", F.col("line_id"))
    return cp.last_wins(a.select("source_id", "text", "line_id", "n_words", "at"), ["source_id", "text"], ["at"]).select("source_id", "text", "line_id", "n_words")


@query(f"""with {_ANS}, s as (select distinct source_id, text from (select source_id, pos, any_value(text) text from sentences group by all) where text is not null)
select source_id, text from s where not exists (select 1 from an where an.source_id = s.source_id and an.text = s.text)""")
def resume_pending(spark, d):
    s = distinct_sentences(spark, d).select("source_id", "text")
    return cp.pending(s, _answers(spark, d), ["source_id", "text"])


@query(f"""with {_ANS}, s as (select distinct source_id, text from (select source_id, pos, any_value(text) text from sentences group by all) where text is not null)
select line_id, source_id, text from an where text is not null and exists (select 1 from s where an.source_id = s.source_id and an.text = s.text)""")
def still_wanted(spark, d):
    s = distinct_sentences(spark, d).select("source_id", "text")
    return cp.still_wanted(_answers(spark, d).select("line_id", "source_id", "text"), s, ["source_id", "text"])


@query(f"""with {_ANS}, s as (select source_id, text, count(*) count, min(pos) ord from (select source_id, pos, any_value(text) text from sentences group by all) where text is not null group by 1, 2),
b as (select source_id, text, arg_max(n_words, line_id) n_words from an where text is not null group by 1, 2) select source_id, text, count, ord, n_words from s join b using (source_id, text)""")
def answered_sentences(spark, d):
    return cp.answered(distinct_sentences(spark, d), checkpoint_last_wins(spark, d).drop("line_id"), ["source_id", "text"])


@query(f"""with {_ANS}, old as (select source_id, text, arg_max(n_words, line_id) n from an where text is not null group by 1, 2), {_SW},
new as (select source_id, text, arg_max(len(words), sw_id) n from sw where text is not null group by 1, 2)
select source_id, text, cast(case when new.text is not null then new.n else old.n end as int) n_words from old full join new using (source_id, text)""")
def fold_in_answers(spark, d):
    """Older answers with newer ones folded in; the newer win."""
    old = checkpoint_last_wins(spark, d).select("source_id", "text", "n_words")
    fresh = sentence_words_once(spark, d).where("text is not null").select("source_id", "text", "sw_id", F.when(F.col("words").isNotNull(), F.size("words")).alias("n_words"))
    new = cp.last_wins(fresh.withColumn("at", F.col("sw_id")), ["source_id", "text"], ["at"]).select("source_id", "text", "n_words")
    return cp.fold_in(old, new, ["source_id", "text"])


@query("""select event_id, cast(s as int) track, case when s = 0 then event_type else '?' end codec, cast(case when s = 0 then json_extract(props, '$.k')::int end as int) channels,
case when s = 0 then 'ger' else 'und' end "language", case when s = 0 then '' else event_type end title from events, unnest(range(2)) u(s)""")
def json_flatten(spark, d):
    """Probe answers made of events: a stream with all tags but the title, and one with the title only."""
    e = read(spark, d, "events")
    payload = F.concat(F.lit('{"streams":[{"codec_name":"'), "event_type", F.lit('","channels":'), F.get_json_object("props", "$.k"), F.lit(',"tags":{"language":"ger"}},{"tags":{"title":"'), "event_type", F.lit('"}}]}'))
    return audio.tracks(e.select("event_id", payload.alias("p")), ["event_id"], "p")


@query("""with s as (select source_id, seg_id, any_value(start_s) a, any_value(end_s) b from segments group by all), t as (select source_id, max(a) done, max(b) total, cast(count(*) as double) elapsed from s group by 1)
select source_id, case when total <> 0 then round(100 * done / total, 6) when total is null then 0 else 0 end pct, round(case when elapsed > 0 then done / elapsed else 0 end, 6) speed,
case when done / elapsed > 0 and total <> 0 then round((total - done) / (done / elapsed) / 60, 6) end minutes_left from t""")
def progress(spark, d):
    s = delivered_once(read(spark, d, "segments"), ["source_id", "seg_id"], "start_s", "end_s")
    t = s.groupBy("source_id").agg(F.max("start_s").alias("done"), F.max("end_s").alias("total"), F.count("*").cast("double").alias("elapsed"))
    pct, speed, left = audio.progress(F.col("done"), F.col("total"), F.col("elapsed"))
    return t.select("source_id", F.round(pct, 6).alias("pct"), F.round(speed, 6).alias("speed"), F.round(left, 6).alias("minutes_left"))


@query("""select source, count(*) n_docs, count(distinct text) n_texts, cast(coalesce(sum(length(text)), 0) as bigint) n_chars, count(*) filter (where text is null) n_null from documents group by source""")
def corpus_stats(spark, d):
    docs = read(spark, d, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct("text").alias("n_texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.count_if(F.col("text").isNull()).alias("n_null"))


@query("select source_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') stamp from (select source_id, any_value(created_at) created_at from sources group by all)")
def utc_stamps(spark, d):
    s = delivered_once(read(spark, d, "sources"), ["source_id"], "created_at")
    return s.select("source_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query(f"with {_CARDS} select distinct {_norm('entry')} entry from cards where {_norm('entry')} <> ''")
def known_entries(spark, d):
    return kn.entries(cards_once(spark, d), "entry")


@query(rf"""with {_ANS}, s as (select distinct text from (select source_id, pos, any_value(text) text from sentences group by all) s where text is not null and not exists (select 1 from an where an.source_id = s.source_id and an.text = s.text)),
t as (select text, list_filter(list_transform(string_split({_squeeze('text')}, ' '), lambda x: regexp_replace(x, '[^\p{{L}}]', '', 'g')), lambda x: x <> '') ws from s),
e as (select text, u.i i, ws[u.i] lemma from t, unnest(range(1, len(ws) + 1)) u(i)), f as (select text, {_fold('lemma')} k, min(i) i, arg_min(lemma, i) lemma from e group by 1, 2)
select text, cast(row_number() over (partition by text order by i) - 1 as int) w_ord, lemma, 'other' word_type, cast(null as varchar) article from f""")
def extracted_words(spark, d):
    """Words of every distinct sentence that has no answer yet, by the deterministic extractor."""
    todo = resume_pending(spark, d).select("text")
    return ex.ask_words(todo, "text", ex.token_extractor).select("text", F.posexplode("words").alias("w_ord", "w")).select("text", "w_ord", "w.lemma", "w.word_type", "w.article")


@query(rf"""with s as (select doc_id, {_split_sql('text')} ss from documents where text is not null), x as (select doc_id, u.i - 1 pos, ss[u.i] text from s, unnest(range(1, len(ss) + 1)) u(i)),
b as (select *, case when regexp_matches(lag(text) over w, '(^|[\s\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}])\p{{Nd}}{{1,2}}\.$') then 0 else 1 end b from x window w as (partition by doc_id order by pos)),
c as (select *, sum(b) over (partition by doc_id order by pos) chain from b)
select doc_id, cast(min(pos) as int) pos, string_agg(text, ' ' order by pos) text from c group by doc_id, chain""")
def document_sentences(spark, d):
    """Sentences of all documents by the rule profile, ordinals mended."""
    return se.split_documents(read(spark, d, "documents").where("text is not null"), ["doc_id"], "text")


@query(f"""with {_WORDS}, a as (select source_id, {_fold('lemma')} lemma_key, word_type, cast(coalesce(sum(count), 0) as bigint) count from w where lemma is not null group by 1, 2, 3 having sum(count) >= 1)
select source_id, lemma_key, word_type, count, cast(row_number() over (partition by source_id order by count desc, lemma_key, word_type) as int) place from a""")
def list_order(spark, d):
    """The list's total order within each source, as places."""
    made = wl.build(words_once(spark, d), ["source_id"], examples=None)
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(*wl.order([])))
    return made.select("source_id", "lemma_key", "word_type", "count", place.alias("place"))


_BOOK = """c as (select chapter_id, any_value(source_id) source_id, any_value(chapter_index) chapter_index, any_value(href) href, any_value(html) html from chapters group by chapter_id),
spine as (select *, chapter_id || '/' || href path, chapter_id % 7 = 0 nav, chapter_id % 5 = 0 untyped, chapter_id % 11 = 0 dangling, chapter_id % 13 = 0 absent from c),
kept as (select *, row_number() over (partition by source_id order by chapter_index nulls first, chapter_id) - 1 "index" from spine where not dangling and not nav and (not untyped or suffix(lower(path), '.xhtml') or suffix(lower(path), '.html') or suffix(lower(path), '.htm')))"""


def _spine(spark, d) -> DataFrame:
    """Chapters as entries of a package: some are navigation, have no media type, are not listed or are missing from the archive."""
    c = delivered_once(read(spark, d, "chapters"), ["chapter_id"], "source_id", "chapter_index", "href", "html")
    every = lambda n: F.pmod("chapter_id", F.lit(n)) == 0
    return c.select(
        "source_id", "chapter_id", "chapter_index", F.concat(F.col("chapter_id").cast("string"), F.lit("/"), "href").alias("href"), "html",
        F.when(every(7), "x nav").alias("properties"), F.when(~every(5), "application/xhtml+xml").alias("media_type"), every(11).alias("dangling"), every(13).alias("absent"),
    )


def _archives(spark, d) -> DataFrame:
    """(path, content) of a book made of every source's chapters."""
    entry = F.struct(F.coalesce("chapter_index", F.lit(-1)).alias("o"), "chapter_id", "href", "html", "properties", "media_type", "dangling", "absent")
    books = _spine(spark, d).where("source_id is not null").groupBy("source_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return books.select(F.col("source_id").cast("string").alias("path"), archive(F.col("entries")).alias("content"))


@query(f"""with {_BOOK} select source_id, cast("index" as int) "index", 'OEBPS/' || path href, length(coalesce(html, '')) n_html from kept where not absent""")
def book_documents(spark, d):
    """Every source's chapters put into an archive and read as a book."""
    found = epub.read_books(_archives(spark, d), on_error="row").where("error is null")
    return found.select(F.col("file").cast("long").alias("source_id"), "index", "href", F.length("html").cast("long").alias("n_html"))


@query(f"""with {_BOOK} select source_id, cast("index" as int) "index", length(coalesce(html, '')) n_html from kept where not absent and ("index" = 0 or "index" between 2 and 3)""")
def selected_documents(spark, d):
    """book_documents() of a selection, which is applied before a document is read."""
    found = epub.read_books(_archives(spark, d), "0, 2-3", on_error="row").where("error is null")
    return found.select(F.col("file").cast("long").alias("source_id"), "index", F.length("html").cast("long").alias("n_html"))


def archive(entries):
    """Books made of entries (chapter_id, href, html, properties, media_type, dangling, absent) in reading order."""

    @F.arrow_udf("binary")
    def make(arr: pa.Array) -> pa.Array:
        made = []
        for rows in arr.to_pylist():
            items = "".join(f'<item id="c{r["chapter_id"]}" href="{quote(r["href"])}"' + (f' media-type="{r["media_type"]}"' if r["media_type"] else "") + (f' properties="{r["properties"]}"' if r["properties"] else "") + "/>" for r in rows if not r["dangling"])
            refs = "".join(f'<itemref idref="c{r["chapter_id"]}"/>' for r in rows)
            members = {"META-INF/container.xml": '<container xmlns="u"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>', "OEBPS/book.opf": f'<package xmlns="u"><manifest>{items}</manifest><spine>{refs}</spine></package>'}
            members |= {"OEBPS/" + r["href"]: r["html"] or "" for r in rows if not r["absent"]}
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                for name, text in members.items():
                    z.writestr(name, text)
            made.append(buffer.getvalue())
        return pa.array(made, pa.binary())

    return make(entries)


@query(f"""with {_BOOK} select source_id, chapter_id, cast("index" as int) "index", path href from kept""")
def package_spine(spark, d):
    """Item references joined to the manifest and numbered, as tables."""
    s = _spine(spark, d)
    manifest = s.where("not dangling").select("source_id", F.col("chapter_id").alias("id"), "href", "media_type", "properties")
    refs = s.select("source_id", F.col("chapter_id").alias("idref"), "chapter_index")
    return epub.spine(refs, manifest, ["source_id"], ["chapter_index", "idref"]).select("source_id", F.col("idref").alias("chapter_id"), "index", "href")


@query("""with c as (select chapter_id, any_value(href) h from chapters group by chapter_id)
select chapter_id, (not chapter_id % 7 = 0) and case when chapter_id % 5 > 0 then chapter_id % 5 in (1, 2) else suffix(lower(h), '.xhtml') or suffix(lower(h), '.html') or suffix(lower(h), '.htm') end is_content from c""")
def content_documents(spark, d):
    c = delivered_once(read(spark, d, "chapters"), ["chapter_id"], "href")
    kind = F.element_at(F.array(*map(F.lit, ("", " TEXT/html", "application/xhtml+xml", "image/png", "text/css"))), F.pmod("chapter_id", F.lit(5)).cast("int") + 1)
    return c.select("chapter_id", epub.content_document(F.col("href"), kind, F.when(F.pmod("chapter_id", F.lit(7)) == 0, "nav x")).alias("is_content"))


@query("select chapter_id, 'OEBPS/a b/' || any_value(href) path from chapters group by chapter_id")
def resolved_hrefs(spark, d):
    c = delivered_once(read(spark, d, "chapters"), ["chapter_id"], "href")
    ref = F.concat(F.lit("../x/.././a%20b/"), "href", F.lit("#p"), F.col("chapter_id").cast("string"))
    return c.select("chapter_id", epub.resolved(F.lit("OEBPS/text"), ref).alias("path"))


@query("""with s as (select source_id, pos, any_value(text) text from sentences where source_id is not null and pos is not null and text is not null group by all)
select source_id, cast(row_number() over (partition by source_id order by pos) - 1 as int) pos, text from s""")
def artifact_records(spark, d):
    """The sentences of every source written as an artifact and read back."""
    s = delivered_once(read(spark, d, "sentences").where("source_id is not null and pos is not null and text is not null"), ["source_id", "pos"], "text")
    docs = s.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("sentences"))
    body = F.to_json(F.struct(F.lit(art.SCHEMA_VERSION).alias("schema_version"), "sentences"))
    return art.records(docs.select("source_id", body.alias("body")), "source_id", "body", "sentences").select("source_id", "pos", F.col("record").alias("text"))


@query(f"""with {_LINES}, r as (select line_id, line::json j from st where status = 'record'),
w as (select line_id, json_type(j, '$.words') = 'ARRAY' listed, case when json_type(j, '$.words') = 'ARRAY' then (j->'$.words')::json[] end ws from r),
e as (select line_id, x, coalesce(json_type(x) = 'OBJECT' and json_type(x, '$.lemma') = 'VARCHAR' and {_squeeze("x->>'$.lemma'")} <> '' and json_type(x, '$.word_type') = 'VARCHAR' and x->>'$.word_type' <> ''
 and (x->>'$.article' is null or x->>'$.article' in ('der', 'die', 'das')), false) ok from (select line_id, unnest(ws) x from w where listed))
select line_id, case when coalesce(listed, false) and coalesce(good, true) then coalesce(n, 0) end n_words
from w left join (select line_id, bool_and(ok) good, count(distinct {_norm("x->>'$.lemma'")} || chr(1) || (x->>'$.word_type')) n from e group by 1) using (line_id)""")
def valid_answers(spark, d):
    """How many words a checked answer has, null where it is refused."""
    lines = _lines(spark, d).where("status = 'record'")
    got = va.word_answers(F.col("line"))
    return lines.select("line_id", got.alias("a")).select("line_id", F.when(F.col("a.error").isNull(), F.size("a.words").cast("long")).alias("n_words"))


@query(f"""select doc_id, case when doc_id % 4 = 0 then null else kind end kind, case when doc_id % 4 = 0 then null else 1 - doc_id % 2 = 0 end is_content,
case when doc_id % 4 = 0 then 0 when {_squeeze("coalesce(title, '')")} = '' then 1 else 2 end n_sentences from documents""")
def valid_verdicts(spark, d):
    """Verdicts made of documents, a fourth of them with a flag that is none."""
    flag = F.when(F.pmod("doc_id", F.lit(4)) == 0, "1").otherwise(F.when(F.pmod("doc_id", F.lit(2)) == 1, "true").otherwise("false"))
    body = F.concat(F.lit('{"is_content":'), flag, F.lit(","), F.expr("substring(to_json(struct(kind, array(coalesce(title, ''), 'x') as sentences)), 2)"))
    got = read(spark, d, "documents").select("doc_id", va.chapter_answers(body).alias("a"))
    return got.select("doc_id", "a.kind", "a.is_content", F.when(F.col("a.error").isNull(), F.size("a.sentences")).otherwise(0).cast("long").alias("n_sentences"))


@query("""select event_id, case event_id % 6 when 0 then null when 1 then 'cut off' when 2 then 'refused' when 3 then 'no content' when 4 then 'no valid JSON' else 'unexpected response' end problem,
case when event_id % 6 = 0 then '"' || event_type || '"' end answer from events""")
def completions(spark, d):
    """Responses made of events, with each way to be unusable, taken apart."""
    e = read(spark, d, "events")
    message = F.element_at(F.array(*[F.lit(x) for x in ('"content":"\\"?\\""', '"content":"{}"', '"refusal":"no","content":"1"', '"content":""', '"content":"{"')]), F.least(F.pmod("event_id", F.lit(6)), F.lit(4)).cast("int") + 1)
    choice = F.concat(F.lit('{"choices":[{'), F.when(F.pmod("event_id", F.lit(6)) == 1, '"finish_reason":"length",').otherwise(""), F.lit('"message":{'), F.replace(message, F.lit("?"), F.col("event_type")), F.lit("}}]}"))
    got = va.completions(F.when(F.pmod("event_id", F.lit(6)) == 5, '{"choices":[]}').otherwise(choice))
    problem = F.regexp_extract("a.error", "cut off|refused|no content|no valid JSON|unexpected response", 0)
    return e.select("event_id", got.alias("a")).select("event_id", problem.alias("problem"), "a.answer")


@query(f"""with {_WORDS}, {_KEYS}, u as (select *, {_fold('lemma')} lemma_key from w where lemma is not null and text is not null and not exists (select 1 from keys where key = {_norm('lemma')}))
select source_id, lemma_key, word_type, text, min(sw_id) sw_id from u group by all""")
def example_rows(spark, d):
    """The examples of every entry as rows, each with the sentence that it is first seen in."""
    rows = wl.example_rows(words_once(spark, d), ["source_id"], known_keys(spark, d))
    return rows.select("source_id", "lemma_key", "word_type", "text", F.col("at.s_ord").alias("sw_id"))


@query(f"""with {_WORDS}, a as (select source_id, {_fold('lemma')} lemma_key, word_type, arg_min(lemma, row(sw_id, w_ord)) lemma, cast(coalesce(sum(count), 0) as bigint) count, count(distinct text) n_sentences from w where lemma is not null and source_id is not null group by 1, 2, 3 having sum(count) >= 2)
select source_id, cast(row_number() over (partition by source_id order by count desc, lemma_key, word_type) - 1 as int) pos, lemma, word_type, count, n_sentences from a""")
def list_documents(spark, d):
    """Every source's list of words seen twice or more, written as a document and read back."""
    made = wl.build(words_once(spark, d), ["source_id"], min_count=2).where("source_id is not null")
    entry = F.struct(F.negate("count").alias("o"), "lemma_key", "word_type", "lemma", "article", "count", F.filter("sentences", lambda t: t.isNotNull()).alias("sentences"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(*[e[c].alias(c) for c in ("lemma", "word_type", "article", "count", "sentences")]))
    docs = made.groupBy("source_id").agg(listed.alias("words"))
    body = F.to_json(F.struct(F.lit(art.SCHEMA_VERSION).alias("schema_version"), F.lit(2).alias("min_count"), "words"))
    rows = art.records(docs.select("source_id", body.alias("body")), "source_id", "body", "words", "min_count int").where("min_count = 2")
    return rows.select("source_id", "pos", "record.lemma", "record.word_type", "record.count", F.size("record.sentences").cast("long").alias("n_sentences"))


@query(f"""with {_CARDS}, e as (select distinct deck_id, {_norm('entry')} word from cards where deck_id is not null and {_norm('entry')} <> '')
select deck_id, cast(row_number() over (partition by deck_id order by word) - 1 as int) pos, word from e""")
def known_documents(spark, d):
    """Every deck's entries, sorted, written as a document and read back."""
    entry = cards_once(spark, d).where("deck_id is not null").select("deck_id", tx.normalize_word(F.col("entry")).alias("word")).where("word <> ''").distinct()
    docs = entry.groupBy("deck_id").agg(F.array_sort(F.collect_list("word")).alias("words"))
    body = F.to_json(F.struct(F.lit(art.SCHEMA_VERSION).alias("schema_version"), "words"))
    return art.records(docs.select("deck_id", body.alias("body")), "deck_id", "body", "known_words").select("deck_id", "pos", F.col("record").alias("word"))

"""All queries of the library by name, with the SQL that must give the same rows.

Inputs that the tables lack (manifests, page sets, limits, image bytes) are derived from the tables by the same rule on both
sides, so that every query's work grows with them.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import js_compat as js
from ..operators import business, catalogue, integrity, media, pages, reshape, text
from ..sources import delimited, files
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t2_text_stats_by(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: in ``spark.checkpoint.dir``, or a temporary one where Spark runs in this process."""
    import tempfile

    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    shared = shared or f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/loomwork-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str):
    """A setting of the session that is put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# --- texts -----------------------------------------------------------------------------------------------------------

_STATS_SQL = r"""select doc_id, lang, source,
    case when regexp_replace(text, '^\s+|\s+$', '', 'g') = '' then 0 else len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) end::int as words,
    length(text)::int as characters, length(regexp_replace(text, '\s', '', 'g'))::int as characters_no_spaces,
    case when text = '' then 0 else len(regexp_split_to_array(text, '\r?\n')) end::int as lines from documents"""


@query(f"select doc_id, words, characters, characters_no_spaces, lines, ceil(words / 225)::int as reading_minutes from ({_STATS_SQL})")
def t1_text_stats(spark, sf_dir):
    return text.text_stats(_table(spark, sf_dir, "documents")).select("doc_id", *text.MEASURES)


@query(f"""select lang, source, grouping(lang, source)::int as level, count(*) as texts, sum(words)::bigint as words, sum(characters)::bigint as characters,
    sum(characters_no_spaces)::bigint as characters_no_spaces, sum(lines)::bigint as lines, sum(ceil(words / 225))::bigint as reading_minutes, round(avg(words), 6) as mean_words
    from ({_STATS_SQL}) group by rollup(lang, source)""")
def t2_text_stats_by(spark, sf_dir):
    return text.text_stats_by(_table(spark, sf_dir, "documents"), ["lang", "source"])


@query(f"""select lang, source, grouping(lang, source)::int as level, 'words' as measure, share::double as share, count(*) as texts, true as within
    from ({_STATS_SQL}), (values (0.5), (0.9), (0.99)) as s(share) group by share, rollup(lang, source)""")
def t2_text_quantiles(spark, sf_dir):
    """Quantiles of words from merged sketches; ``within`` says whether each one's rank, counted exactly, is off by no more than
    the sketch allows."""
    docs, dims = _table(spark, sf_dir, "documents"), ["lang", "source"]
    found = text.text_quantiles_by(text.text_sketches(docs, dims), dims)
    counts = text.text_stats(docs).groupBy(*dims, "words").agg(F.count("*").alias("n"))
    sets = counts.groupingSets([[*map(F.col, dims), F.col("words")], [F.col("lang"), F.col("words")], [F.col("words")]], *map(F.col, (*dims, "words")))
    exact = sets.agg((F.grouping_id() / 2).cast("int").alias("level"), F.sum("n").alias("n")).select(*(F.col(c).alias(f"_{c}") for c in (*dims, "level")), F.col("words").alias("w"), "n")
    same = F.expr("level = _level and lang <=> _lang and source <=> _source")
    part = lambda c: F.sum(F.when(F.expr(c), F.col("n")).otherwise(0)) / F.col("texts")
    ranked = found.join(exact, same).groupBy(*dims, "level", "measure", "share", "texts").agg(part("w < quantile").alias("below"), part("w <= quantile").alias("upto"))
    return ranked.select(*dims, "level", "measure", "share", "texts", F.expr(f"below <= share + {text.RANK_ERROR} and upto >= share - {text.RANK_ERROR}").alias("within"))


def _edited(docs: DataFrame) -> DataFrame:
    """An edited copy of the documents: k for q, a line more for even ids, and every 50th id gone."""
    more = F.when(F.col("doc_id") % 2 == 0, "\nEnd.").otherwise("")
    return docs.where("doc_id % 50 <> 0").select("doc_id", F.concat(F.translate("text", "q", "k"), more).alias("text"))


_DIFF_SQL = r"""
    (with edited as (select doc_id, translate(text, 'q', 'k') || case when doc_id % 2 = 0 then chr(10) || 'End.' else '' end as text from documents where doc_id % 50 <> 0)
    , l as (select doc_id, unnest(regexp_split_to_array(text, '\r?\n')) as line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) as line_no from documents)
    , r as (select doc_id, unnest(regexp_split_to_array(text, '\r?\n')) as line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) as line_no from edited)
    , b as (select coalesce(l.doc_id, r.doc_id) as doc_id, coalesce(l.line_no, r.line_no)::int as line_no, l.line as a, r.line as b from l full join r on l.doc_id = r.doc_id and l.line_no = r.line_no)
    select doc_id, line_no, 'same' as type, a as "left", b as "right", 0 as seq from b where a = b
    union all select doc_id, line_no, 'removed', a, null, 0 from b where a is not null and a is distinct from b
    union all select doc_id, line_no, 'added', null, b, 1 from b where b is not null and a is distinct from b)"""


def _diff(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.line_diff(docs, _edited(docs), "doc_id")


@query(f"select * from {_DIFF_SQL}")
def t3_line_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(r"""with v as (select conv_id, turn, lag(text) over (partition by conv_id order by turn) as before, text from conversations)
    , l as (select conv_id, turn, unnest(regexp_split_to_array(before, '\r?\n')) as line, generate_subscripts(regexp_split_to_array(before, '\r?\n'), 1) as line_no from v where before is not null)
    , r as (select conv_id, turn, unnest(regexp_split_to_array(text, '\r?\n')) as line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) as line_no from v)
    , b as (select coalesce(l.conv_id, r.conv_id) as conv_id, coalesce(l.turn, r.turn) as turn, coalesce(l.line_no, r.line_no)::int as line_no, l.line as a, r.line as b
        from l full join r on l.conv_id = r.conv_id and l.turn = r.turn and l.line_no = r.line_no)
    select conv_id, turn, line_no, 'same' as type, a as "left", b as "right", 0 as seq from b where a = b
    union all select conv_id, turn, line_no, 'removed', a, null, 0 from b where a is not null and a is distinct from b
    union all select conv_id, turn, line_no, 'added', null, b, 1 from b where b is not null and a is distinct from b""")
def t4_diff_versions(spark, sf_dir):
    return text.diff_versions(_table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(f"""select doc_id, count(*) filter (type = 'same') as same, count(*) filter (type = 'removed') as removed, count(*) filter (type = 'added') as added,
    count(*) filter (type <> 'same') as changed from {_DIFF_SQL} group by doc_id""")
def t5_diff_summary(spark, sf_dir):
    return text.diff_summary(_diff(spark, sf_dir), "doc_id")


@query(f"""select doc_id, string_agg(case type when 'same' then '  ' when 'removed' then '- ' else '+ ' end || coalesce("left", "right"), chr(10) order by line_no, seq) as patch
    from {_DIFF_SQL} group by doc_id""")
def t6_diff_text(spark, sf_dir):
    return text.diff_text(_diff(spark, sf_dir), "doc_id")


def _marked(docs: DataFrame) -> DataFrame:
    """Texts with markup: the lines of a document under a heading, every line that starts with a vowel as an item."""
    return docs.select("doc_id", F.concat(F.lit("## "), F.col("source"), F.lit("\n\n"), F.regexp_replace("text", r"(?m)^([AEIO])", "- $1"), F.lit("\n# end")).alias("text"))


_BLOCK_SQL = r"""
    (with marked as (select doc_id, '## ' || source || chr(10) || chr(10) || regexp_replace(text, '(?m)^([AEIO])', '- \1', 'g') || chr(10) || '# end' as text from documents)
    , l as (select doc_id, unnest(regexp_split_to_array(text, '\r?\n')) as line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1)::int as line_no from marked)
    select doc_id, line_no, case when starts_with(line, '### ') then 'h3' when starts_with(line, '## ') then 'h2' when starts_with(line, '# ') then 'h1' when starts_with(line, '- ') then 'item'
            when trim(line) = '' then 'gap' else 'paragraph' end as block,
        case when starts_with(line, '### ') then substr(line, 5) when starts_with(line, '## ') then substr(line, 4) when starts_with(line, '# ') or starts_with(line, '- ') then substr(line, 3) else line end as text
    from l)"""


@query(f"select * from {_BLOCK_SQL}")
def t7_markup_blocks(spark, sf_dir):
    return text.markup_blocks(_marked(_table(spark, sf_dir, "documents")), "doc_id")


@query(f"""with w as (select *, case when lag(block) over (partition by doc_id order by line_no) = block then 0 else 1 end as new from {_BLOCK_SQL})
    , r as (select *, sum(new) over (partition by doc_id order by line_no)::int as run_id from w)
    select doc_id, run_id, block, min(line_no) as first_line, count(*) as n_lines from r group by doc_id, run_id, block""")
def t8_block_runs(spark, sf_dir):
    return text.block_runs(text.markup_blocks(_marked(_table(spark, sf_dir, "documents")), "doc_id"), "doc_id")


@query(r"select doc_id, regexp_replace(text, '[\t\n\r\x20-\x7E]', '', 'g') = '' as ok, length(regexp_replace(text, '[\t\n\r\x20-\x7E]', '', 'g'))::int as bad_chars from documents")
def t9_encodability(spark, sf_dir):
    return text.encodability(_table(spark, sf_dir, "documents"), "doc_id", allowed=r"\t\n\r\x20-\x7E")


@query(r"""select lang, char, count(*) as n from (select lang, unnest(string_split(regexp_replace(text, '[\t\n\r\x20-\x7E]', '', 'g'), '')) as char from documents)
    where char <> '' group by lang, char""")
def t9_bad_characters(spark, sf_dir):
    return text.bad_characters(_table(spark, sf_dir, "documents"), "lang", allowed=r"\t\n\r\x20-\x7E")


@query(r"""with p as (select doc_id, unnest(regexp_split_to_array(text, '\r?\n')) as para, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) as par from documents)
    , w as (select doc_id, par, array_to_string(flatten([regexp_extract_all(x, '.{1,86}') for x in regexp_extract_all(para, '\S+')]), ' ') as words from p)
    , l as (select doc_id, par, unnest(lines) as line, generate_subscripts(lines, 1) as place from (
        select doc_id, par, case when words = '' then [''] else regexp_extract_all(words, '([^ ](?:.{0,84}[^ ])?)(?: |$)', 1) end as lines from w))
    , n as (select doc_id, line, row_number() over (partition by doc_id order by par, place) - 1 as line_no from l)
    select doc_id, (line_no // 43)::int as page_idx, line_no::int as line_no, line from n""")
def t10_paginate(spark, sf_dir):
    return text.paginate(_table(spark, sf_dir, "documents"), "doc_id")


PAGE_FIELDS = [("Title", "<title>([^<]*)"), ("Language", 'lang="([^"]*)"'), ("Heading", "<h1>([^<]*)"), ("Description", 'name="description" content="([^"]*)')]


@query("""select page_id, label, value from (select page_id, unnest(case when len(f) > 0 then f else [{'label': 'present', 'value': ''}] end, recursive := true) from (
    select page_id, list_filter([{'label': 'Title', 'value': regexp_extract(html, '<title>([^<]*)', 1)}, {'label': 'Language', 'value': regexp_extract(html, 'lang="([^"]*)"', 1)},
        {'label': 'Heading', 'value': regexp_extract(html, '<h1>([^<]*)', 1)}, {'label': 'Description', 'value': regexp_extract(html, 'name="description" content="([^"]*)', 1)}], lambda x: x.value <> '') as f from pages))""")
def t11_extract_fields(spark, sf_dir):
    return text.extract_fields(_table(spark, sf_dir, "pages"), "page_id", PAGE_FIELDS, "html")


# --- integrity -------------------------------------------------------------------------------------------------------


@query("select doc_id, sha256(text) as sha256 from documents")
def h1_content_hash(spark, sf_dir):
    return integrity.content_hash(_table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""select doc_id, sha256, n, keep_id from (select doc_id, sha256(text) as sha256, count(*) over (partition by sha256(text)) as n, min(doc_id) over (partition by sha256(text)) as keep_id from documents) where n > 1""")
def h2_duplicate_groups(spark, sf_dir):
    return integrity.duplicate_groups(h1_content_hash(spark, sf_dir), "doc_id")


@query("""with expected as (select doc_id, case when doc_id % 11 = 0 then 'f00d' when doc_id % 13 = 0 then ' ' when doc_id % 5 = 0 then upper(sha256(text)) || ' ' else sha256(text) end as expected from documents where doc_id % 7 <> 0
        union all select -1 - doc_id, 'x' from documents where doc_id % 17 = 0)
    select coalesce(a.doc_id, e.doc_id) as doc_id, case when a.doc_id is null then 'missing' when e.doc_id is null then 'unlisted' when trim(expected) = '' then 'no_expected'
        when lower(trim(expected)) = sha256(a.text) then 'match' else 'mismatch' end as status from documents a full join expected e on a.doc_id = e.doc_id""")
def h3_verify_manifest(spark, sf_dir):
    actual = h1_content_hash(spark, sf_dir)
    i = F.col("doc_id")
    wanted = F.when(i % 11 == 0, "f00d").when(i % 13 == 0, " ").when(i % 5 == 0, F.concat(F.upper("sha256"), F.lit(" "))).otherwise(F.col("sha256"))
    expected = actual.where("doc_id % 7 <> 0").select("doc_id", wanted.alias("expected")).union(actual.where("doc_id % 17 = 0").select((-1 - i).alias("doc_id"), F.lit("x")))
    return integrity.verify_manifest(actual, expected, "doc_id")


@query("""select doc_id, doc_id % 10 not in (3, 4) as ok, case doc_id % 10 when 3 then 'not_base64' when 4 then 'not_utf8' end as reason, case when doc_id % 10 not in (3, 4) then text end as decoded from documents""")
def h4_decode_payloads(spark, sf_dir):
    i = F.col("doc_id")
    payload = F.when(i % 10 == 3, F.concat(F.lit("%%%"), js.base64(F.col("text")))).when(i % 10 == 4, F.lit("//79")).otherwise(F.base64(F.encode("text", "UTF-8")))
    return integrity.decode_payloads(_table(spark, sf_dir, "documents").select("doc_id", payload.alias("payload")), "doc_id", "payload")


@query("select doc_id, base64(encode(text)) as payload from documents")
def h5_encode_payloads(spark, sf_dir):
    return integrity.encode_payloads(_table(spark, sf_dir, "documents"), "doc_id", "text")


_URL = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"


@query(f"""with q as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host, {_URL} as path, regexp_extract(url, '[?]([^#]*)', 1) as q from pages)
    , p as (select page_id, host, path, unnest(case when q = '' then [null] else string_split(q, '&') end) as pair from q)
    select page_id, host, path, string_split(pair, '=')[1] as param, case when pair is not null then string_split(pair, '=')[2] end as raw, case when pair is not null then string_split(pair, '=')[2] end as value, true as ok from p""")
def h6_url_components(spark, sf_dir):
    return integrity.url_components(_table(spark, sf_dir, "pages"), "page_id", "url")


@query("select doc_id, replace(replace(replace(replace(replace(replace(url_encode(text), '%2A', '*'), '%21', '!'), '%7E', '~'), '%27', ''''), '%28', '('), '%29', ')') as encoded from documents")
def h7_url_encode(spark, sf_dir):
    return integrity.url_encode_col(_table(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"""with t as (select doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{32,64}')) as token from documents)
    , b as (select doc_id, token, round(length(token) * log2(case when regexp_matches(token, '[a-z]') then 26 else 0 end + case when regexp_matches(token, '[0-9]') then 10 else 0 end))::int as bits from t)
    select doc_id, sha256(token) as token_sha256, bits, case when bits >= 80 then 4 when bits >= 60 then 3 when bits >= 40 then 2 else 1 end as score,
        case when bits >= 80 then 'Very strong' when bits >= 60 then 'Strong' when bits >= 40 then 'Good' else 'Fair' end as label from b""")
def h8_secret_strength(spark, sf_dir):
    return integrity.secret_strength(_table(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"""with t as (select doc_id, unnest(regexp_extract_all(text, '[^\s]{9,}')) as token from documents)
    , b as (select doc_id, token, round(length(token) * log2(greatest(case when regexp_matches(token, '[a-z]') then 26 else 0 end + case when regexp_matches(token, '[A-Z]') then 26 else 0 end
        + case when regexp_matches(token, '[0-9]') then 10 else 0 end + case when regexp_matches(token, '[^A-Za-z0-9]') then 28 else 0 end, case when regexp_matches(token, '[_-]') then 48 else 0 end)))::int as bits from t)
    select doc_id, sha256(token) as token_sha256, bits, case when bits >= 80 then 4 when bits >= 60 then 3 when bits >= 40 then 2 else 1 end as score,
        case when bits >= 80 then 'Very strong' when bits >= 60 then 'Strong' when bits >= 40 then 'Good' else 'Fair' end as label from b""")
def h8_strength_of_long_words(spark, sf_dir):
    """All words of nine and more characters as secrets, so that every class of characters occurs."""
    return integrity.secret_strength(_table(spark, sf_dir, "documents"), "doc_id", "text", r"\S{9,}")


# --- semi-structured records -----------------------------------------------------------------------------------------


def _records(spark, sf_dir):
    """Events as JSON records with several keys; every ninth is cut off, every tenth an array."""
    props = F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('", "user": '), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ', "flag": "yes"').otherwise(""), F.lit(', "props": '), F.col("props"), F.lit("}"))
    json = F.when(F.col("event_id") % 9 == 0, F.regexp_replace(props, "}$", "")).when(F.col("event_id") % 10 == 0, F.lit("[1, 2]")).otherwise(props)
    return _table(spark, sf_dir, "events").select("event_id", json.alias("json"))


_RECORDS = """(select event_id, case when event_id % 9 = 0 then j[:-2] when event_id % 10 = 0 then '[1, 2]' else j end as json from (
    select event_id, '{"kind": "' || event_type || '", "user": ' || user_id || case when event_id % 3 = 0 then ', "flag": "yes"' else '' end || ', "props": ' || props || '}' as j from events))"""
_GOOD = "event_id % 9 <> 0 and event_id % 10 <> 0"


_MINIFIED = r"""regexp_replace({}, '("(?:[^"\\]|\\.)*")|[ \t\n\r]+', '\1', 'g')"""
# valid, and without the commas at the end of lists and the words for numbers that one side lets pass
_VALID = r"""coalesce(json_valid({0}) and not regexp_matches(regexp_replace({0}, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',[ \t\n\r]*[]}}]|[Nn]a[Nn]|[Ii]nf'), false)"""
_GATE_SQL = """select event_id, ok, reason, minified, octet_length(encode(json))::int as bytes_before, octet_length(encode(minified))::int as bytes_after from (
    select *, case when json is null then 'null' when not ok then 'syntax' end as reason, case when ok then {} end as minified from (select event_id, json, {} as ok from {}))"""


@query(_GATE_SQL.format(_MINIFIED.format("json"), _VALID.format("json"), "(select event_id, props as json from events)"))
def i5_json_gate(spark, sf_dir):
    return reshape.json_gate(_table(spark, sf_dir, "events"), "event_id", "props")


def _faulty(spark, sf_dir):
    """Records with one fault of each kind, or none: bad tails, quotes, numbers, escapes and commas, repeated keys, line ends."""
    i, q = F.col("event_id"), F.lit
    j = F.concat(q('{"kind": "'), F.col("event_type"), q('", "user": '), F.col("user_id").cast("string"), q(', "props": '), F.col("props"), q("}"))
    cases = [
        F.concat(j, q(" x")), F.replace(j, q('"'), q("'")), F.replace(j, q('"user": '), q('"user": NaN, "n": ')), F.concat(q('{"user": 1e2, '), F.substr(j, q(2))),
        F.replace(j, q(": "), q(" :\n\t")), F.concat(q("["), j, q(",]")), F.replace(j, q('"kind": "'), q('"kind": "\x01')), F.concat(q("[ "), j, q(' , "a\\u00e9 \\" \\n b" , -0.5E+3 ]')),
        F.replace(j, q('"kind": "'), q('"kind": "\\x')), F.replace(j, q('"user": '), q('"user": 0')), F.lit(None), q(' "alone" '), j,
    ]
    return _table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*cases), (i % len(cases) + 1).cast("int")).alias("json"))


_FAULTY = r"""(select event_id, case event_id % 13 when 0 then j || ' x' when 1 then replace(j, '"', chr(39)) when 2 then replace(j, '"user": ', '"user": NaN, "n": ') when 3 then '{"user": 1e2, ' || substr(j, 2)
    when 4 then replace(j, ': ', ' :' || chr(10) || chr(9)) when 5 then '[' || j || ',]' when 6 then replace(j, '"kind": "', '"kind": "' || chr(1)) when 7 then '[ ' || j || ' , "a\u00e9 \" \n b" , -0.5E+3 ]'
    when 8 then replace(j, '"kind": "', '"kind": "\x') when 9 then replace(j, '"user": ', '"user": 0') when 10 then null when 11 then ' "alone" ' else j end as json from (
    select event_id, '{"kind": "' || event_type || '", "user": ' || user_id || ', "props": ' || props || '}' as j from events))"""


@query(_GATE_SQL.format(_MINIFIED.format("json"), _VALID.format("json"), _FAULTY))
def i5_json_gate_rejects(spark, sf_dir):
    return reshape.json_gate(_faulty(spark, sf_dir), "event_id", "json")


@query(f"""with k as (select event_id, unnest(json_keys(json)) as key, generate_subscripts(json_keys(json), 1) - 1 as pos from {_RECORDS} where {_GOOD})
    select key, min(event_id) as first_row, arg_min(pos, event_id)::int as first_pos, count(*) as n_rows, 0 as first_item from k group by key""")
def r1_discover_keys(spark, sf_dir):
    return reshape.discover_keys(_records(spark, sf_dir), "json", "event_id")


def _feeds(spark, sf_dir):
    """Records as objects, arrays of objects, and arrays and values that give no table; some numbers have exponents. The
    events are dealt out first, as a task of a small file of events would make and read a great many texts."""
    i, q = F.col("event_id"), F.lit
    number = F.concat(F.col("user_id").cast("string"), F.when(i % 7 == 0, "e2").when(i % 7 == 1, ".50").when(i % 7 == 2, ".0").otherwise(""))
    more = F.when(i % 3 == 0, ', "flag": null, "Kind": "1e2", "item": true').otherwise("")
    j = F.concat(q('{"kind": "'), F.col("event_type"), q('", "user": '), number, more, q(', "props": '), F.col("props"), q("}"))
    json = (
        F.when(i % 9 == 0, F.regexp_replace(j, "}$", "")).when(i % 10 == 0, '["a", "b"]').when(i % 11 == 0, F.concat(q("["), j, q(", null]"))).when(i % 13 == 0, "[[1, 2]]")
        .when(i % 8 == 0, F.concat(q("["), j, q(", "), j, q("]"))).when(i % 14 == 0, "[ {} ]").when(i % 17 == 0, "3").when(i % 19 == 0, None).otherwise(j)
    )
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props").repartition("event_id")
    return events.select("event_id", json.alias("json"))


_FEEDS = """(select event_id, event_type as kind, case event_id % 7 when 0 then (user_id * 100)::varchar when 1 then user_id || '.5' else user_id::varchar end as user, event_id % 3 = 0 as more, replace(props, ' ', '') as props,
    case when event_id % 9 = 0 then 'syntax' when event_id % 10 = 0 or event_id % 11 = 0 or event_id % 13 = 0 then 'not_objects' when event_id % 8 = 0 then null when event_id % 14 = 0 then 'no_fields'
        when event_id % 17 = 0 then 'not_array' when event_id % 19 = 0 then 'null' end as reason, case when event_id % 8 = 0 then [0, 1] else [0] end as items from events)"""


@query(f"""select event_id, unnest(items)::int as item, kind, user, '' as flag, case when more then '1e2' else '' end as "Kind_2", case when more then 'true' else '' end as item_2, props, '' as more from {_FEEDS} where reason is null""")
def r2_json_to_wide(spark, sf_dir):
    """Columns as they are discovered: kind, user, props, flag, Kind and item, whose names are told apart."""
    return reshape.json_to_wide(_feeds(spark, sf_dir), "event_id", "json")


@query(f"""select event_id, unnest(items)::int as item, kind, '{{"user":"' || user || '"' || case when more then ',"flag":"","Kind":"1e2","item":"true"' else '' end || ',"props":' || to_json(props)::varchar || '}}' as more
    from {_FEEDS} where reason is null""")
def r2_json_to_wide_named(spark, sf_dir):
    """One column, and all other fields in the text beside it."""
    return reshape.json_to_wide(_feeds(spark, sf_dir), "event_id", "json", ["kind"])


@query(f"""select event_id, item, f.field as field, f.value as value from (select event_id, unnest(items)::int as item, fields from (select event_id, items, [{{'field': 'kind', 'value': kind}}, {{'field': 'user', 'value': user}}, {{'field': 'props', 'value': props}}]
    || case when more then [{{'field': 'flag', 'value': ''}}, {{'field': 'Kind', 'value': '1e2'}}, {{'field': 'item', 'value': 'true'}}] else [] end as fields from {_FEEDS} where reason is null)), unnest(fields) as u(f)""")
def r2_json_to_long(spark, sf_dir):
    return reshape.json_to_long(_feeds(spark, sf_dir), "event_id", "json")


@query(f"select event_id, reason from {_FEEDS} where reason is not null")
def r2_wide_rejects(spark, sf_dir):
    return reshape.wide_rejects(_feeds(spark, sf_dir), "event_id", "json")


@query("""select c_custkey, '{"c_name":"' || c_name || '","c_nationkey":"' || c_nationkey || '","c_mktsegment":"' || c_mktsegment || '"}' as json from customer""")
def r3_rows_to_json(spark, sf_dir):
    return reshape.rows_to_json(_table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


def _leaves(spark, sf_dir):
    return reshape.leaf_paths(_records(spark, sf_dir), "event_id", "json")


_WELL = f"(select event_id, case when {_GOOD} then json else '{{}}' end as json from {_RECORDS})"
_LEAVES = f"""(select event_id, 'kind' as path, 'string' as kind, json ->> 'kind' as value, false as truncated from {_WELL} where {_GOOD}
    union all select event_id, 'user', 'bigint', json ->> 'user', false from {_WELL} where {_GOOD}
    union all select event_id, 'flag', 'string', json ->> 'flag', false from {_WELL} where {_GOOD} and event_id % 3 = 0
    union all select event_id, 'props.k', case when json_type(json -> 'props' -> 'k') = 'VARCHAR' then 'string' else 'bigint' end, json -> 'props' ->> 'k', false from {_WELL} where {_GOOD}
    union all select event_id, '[0]', 'bigint', '1', false from events where event_id % 10 = 0 and event_id % 9 <> 0
    union all select event_id, '[1]', 'bigint', '2', false from events where event_id % 10 = 0 and event_id % 9 <> 0)"""


@query(f"select * from {_LEAVES}")
def r4_leaf_paths(spark, sf_dir):
    return _leaves(spark, sf_dir)


@query(f"""select event_id, case when json is null then 'null' when not {_VALID.format("json")} then 'syntax' else 'repeated_keys' end as reason from {_FAULTY} where json is null or not {_VALID.format("json")} or event_id % 13 = 3""")
def r4_leaf_rejects(spark, sf_dir):
    return reshape.leaf_rejects(_faulty(spark, sf_dir), "event_id", "json")


@query(rf"""with c as (select path, case when trim(value) = '' then 'blank' when trim(value) <> value or regexp_matches(value, '[:#\r\n\t]') then 'marks'
        when lower(value) in ('y', 'n', 'yes', 'no', 'on', 'off', 'true', 'false', 'null', '~') then 'word' when regexp_full_match(value, '[-+.0-9eE]+') and try_cast(value as double) is not null then 'number' end as rule, count(*) as n
        from {_LEAVES} where value is not null group by all)
    select path, rule, n, share from (select *, round(n / sum(n) over (partition by path), 9) as share from c) where rule is not null""")
def r5_ambiguous_scalars(spark, sf_dir):
    return reshape.ambiguous_scalars(_leaves(spark, sf_dir))


def _dropped(spark, sf_dir):
    """A name for each document, and one that all customers have as a field."""
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name")).union(spark.range(2).select(F.lit("c_name").alias("name")))


_R6 = """(select c_custkey, '{"c_nationkey":"' || c_nationkey || '","c_mktsegment":"' || c_mktsegment || '"' as kept, 'n' || c_custkey as field, c_name, 'n' || c_custkey in (select 'n' || doc_id from documents) as gone from customer)"""


@query(f"""select c_custkey, cleaned, 1 + gone::int as dropped, octet_length(encode(kept)) + octet_length(encode(c_name)) + 12 + octet_length(encode(field)) + 8 as bytes_before, octet_length(encode(cleaned)) as bytes_after
    from (select *, kept || case when gone then '' else ',"' || field || '":"x"' end || '}}' as cleaned from {_R6})""")
def r6_drop_sensitive(spark, sf_dir):
    fields = [(F.lit("c_name"), F.col("c_name")), *((F.lit(c), F.col(c).cast("string")) for c in ("c_nationkey", "c_mktsegment")), (F.concat(F.lit("n"), F.col("c_custkey").cast("string")), F.lit("x"))]
    customers = _table(spark, sf_dir, "customer").select("c_custkey", F.create_map(*(x for f in fields for x in f)).alias("m"))
    cleaned = reshape.drop_sensitive(customers, "c_custkey", "m", _dropped(spark, sf_dir))
    return cleaned.select("c_custkey", "cleaned", "dropped", *(F.col(c).cast("long").alias(c) for c in ("bytes_before", "bytes_after")))


@query("""select count(*) as n, sum(n_chars)::bigint as total_before, sum(length(replace(text, ' ', '')))::bigint as total_after, count(*) filter (length(replace(text, ' ', '')) >= n_chars) as grew,
    round(sum(length(replace(text, ' ', ''))) / sum(n_chars), 6) as ratio from documents""")
def z2_size_report(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return reshape.size_report(docs.select("doc_id", F.col("n_chars").alias("bytes")), docs.select("doc_id", F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("long").alias("bytes")), "doc_id")


@query("""select unit, count(*) as n, sum(b)::bigint as bytes, case when sum(b) <= 0 then '0 B' when sum(b) < 1024 then sum(b)::bigint || ' B' when sum(b) < 1048576 then printf('%.2f KB', sum(b)::double / 1024)
    when sum(b) < 1073741824 then printf('%.2f MB', sum(b)::double / 1048576) else printf('%.2f GB', sum(b)::double / 1073741824) end as label
    from (select b, case when b < 1024 then 'B' when b < 1048576 then 'KB' when b < 1073741824 then 'MB' else 'GB' end as unit from (select n_chars::bigint * (1024 ** (doc_id % 4))::bigint as b from documents)) group by unit""")
def z1_size_histogram(spark, sf_dir):
    """Characters of the documents as bytes, kilobytes, megabytes and gigabytes, by turns."""
    power = F.pow(F.lit(1024.0), F.col("doc_id") % 4).cast("long")
    return reshape.size_histogram(_table(spark, sf_dir, "documents").select((F.col("n_chars").cast("long") * power).alias("b")), "b")


# --- catalogue -------------------------------------------------------------------------------------------------------

SEARCHES = {1: "blue", 2: "steel 1", 3: "part red", 4: "", 5: "nothing-like-this", 6: "a"}


def _catalogue(spark, sf_dir):
    """The parts as a catalogue; a few have repeated routes, are not available, or have an unknown category."""
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("name"), F.when(k % 97 == 0, "Other").otherwise(F.col("p_brand")).alias("category"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("description"),
        F.split("p_type", " ").alias("keywords"), k.alias("ord"), F.concat(F.lit("part-"), F.when(k % 50 == 0, k - 1).otherwise(k).cast("string")).alias("route"), F.when(k % 40 == 0, "draft").otherwise("available").alias("status"),
    )


def _categories(spark, sf_dir):
    brands = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("category")).distinct()
    return brands.select("category", F.regexp_extract("category", "([0-9]+)", 1).cast("int").alias("cat_ord"))


_CATALOGUE = """(select p_partkey as id, p_name as name, case when p_partkey % 97 = 0 then 'Other' else p_brand end as category, 'size ' || p_size as description, string_split(p_type, ' ') as keywords, p_partkey as ord,
    'part-' || case when p_partkey % 50 = 0 then p_partkey - 1 else p_partkey end as route, case when p_partkey % 40 = 0 then 'draft' else 'available' end as status from part)"""
_CATEGORIES = "(select distinct p_brand as category, regexp_extract(p_brand, '([0-9]+)', 1)::int as cat_ord from part)"
_HAY = "lower(name || ' ' || category || ' ' || description || ' ' || array_to_string(keywords, ' '))"


def _hits_sql(k: int) -> str:
    parts = []
    for q, searched in SEARCHES.items():
        score = "0"
        for t in searched.lower().split():
            score += f""" + case when not contains({_HAY}, '{t}') then null when lower(name) = '{t}' then 100 when starts_with(lower(name), '{t}') then 60 when contains(lower(name), '{t}') then 40
                when contains(lower(array_to_string(keywords, ' ')), '{t}') then 20 when contains(lower(description), '{t}') then 10 else 5 end"""
        parts.append(f"select {q} as query_id, id, ord, {score} as score from {_CATALOGUE}")
    return f"""(select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, ord, id)::int as rank from ({' union all '.join(parts)}) where score is not null) where rank <= {k})"""


@query(f"select * from {_hits_sql(25)}")
def s1_keyword_search(spark, sf_dir):
    return catalogue.keyword_search(_catalogue(spark, sf_dir), SEARCHES, 25)


_QUERY_SQL = """(select p_partkey as query_id, case when p_partkey % 50 = 0 then ' ' else substr(p_name, 1 + p_partkey % 3, 4) || ' ' || p_partkey % 7 || case when p_partkey % 5 = 0 then ' Zz' when p_partkey % 5 = 1 then '  ' || p_type || ' ' || p_type else '' end end as text from part)"""


@query(f"""with q as (select query_id, list_filter(string_split(lower(text), ' '), lambda t: t <> '') as tokens from {_QUERY_SQL})
    , c as (select id, ord, lower(name) as name, lower(array_to_string(keywords, ' ')) as words, lower(description) as about, {_HAY} as hay from {_CATALOGUE})
    , p as (select query_id, id, ord, coalesce(list_sum([case when name = t then 100 when starts_with(name, t) then 60 when contains(name, t) then 40 when contains(words, t) then 20 when contains(about, t) then 10 else 5 end for t in tokens]), 0)::int as score
        from q, c where len([t for t in tokens if not contains(hay, t)]) = 0)
    select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, ord, id)::int as rank from p) where rank <= 10""")
def s1_search_table(spark, sf_dir):
    """A query for each part: some letters of its name and a number, with words that do not occur or occur twice, or nothing."""
    k, q = F.col("p_partkey"), F.lit
    more = F.when(k % 5 == 0, " Zz").when(k % 5 == 1, F.concat(q("  "), F.col("p_type"), q(" "), F.col("p_type"))).otherwise("")
    text_of = F.when(k % 50 == 0, " ").otherwise(F.concat(F.substring("p_name", (1 + k % 3).cast("int"), F.lit(4)), q(" "), (k % 7).cast("string"), more))
    asked = _table(spark, sf_dir, "part").select(k.alias("query_id"), text_of.alias("text"))
    return catalogue.search_table(_catalogue(spark, sf_dir), asked, 10)


def _page_sql(page: int) -> str:
    return f"""(with t as (select query_id, count(*) as total, greatest(ceil(count(*) / 10), 1)::int as total_pages from {_hits_sql(25)} group by query_id)
        , p as (select *, least({page}, total_pages) as page from t)
        select h.*, total, total_pages, page, (page - 1) * 10 + 1 as from_row, least(page * 10, total) as to_row from {_hits_sql(25)} h join p using (query_id) where rank between (page - 1) * 10 + 1 and least(page * 10, total))"""


@query(f"select * from {_page_sql(3)}")
def s2_page_of(spark, sf_dir):
    return catalogue.page_of(s1_keyword_search(spark, sf_dir), 3)


@query(f"""select query_id, category, cat_ord, count(*) as n, string_agg(id::varchar, ',' order by id) as ids from {_page_sql(1)} join (select id, category from {_CATALOGUE}) using (id) join {_CATEGORIES} using (category) group by all""")
def s3_facet_page(spark, sf_dir):
    return catalogue.facet_page(catalogue.page_of(s1_keyword_search(spark, sf_dir), 1), _catalogue(spark, sf_dir), _categories(spark, sf_dir))


@query(f"select category, cat_ord, coalesce(n, 0) as n from {_CATEGORIES} left join (select category, count(*) as n from {_CATALOGUE} group by category) using (category)")
def s4_category_counts(spark, sf_dir):
    return catalogue.category_counts(_catalogue(spark, sf_dir), _categories(spark, sf_dir))


@query(f"select id, name from {_CATALOGUE} where category = 'Brand#11' and contains({_HAY}, 'e')")
def s5_category_filter(spark, sf_dir):
    return catalogue.category_filter(_catalogue(spark, sf_dir), "Brand#11", " E ").select("id", "name")


@query(f"""select id, other, rank from (select a.id, b.id as other, row_number() over (partition by a.id order by b.ord, b.id)::int as rank from {_CATALOGUE} a join {_CATALOGUE} b on a.category = b.category and a.id <> b.id) where rank <= 6""")
def s6_related_items(spark, sf_dir):
    return catalogue.related_items(_catalogue(spark, sf_dir))


_RECENT = """(select user_id, item, rank from (select user_id, item, row_number() over (partition by user_id order by ts desc, event_id desc, item)::int as rank from (
    select user_id, event_type as item, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by all)) where rank <= 6)"""


def _recent(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("item"), "ts", "event_id")
    return catalogue.recent_items(events, "user_id", "item", "ts", "event_id")


@query(f"select * from {_RECENT}")
def s7_recent_items(spark, sf_dir):
    return _recent(spark, sf_dir)


@query(f"select * from {_RECENT}")
def s8_stream_recent(spark, sf_dir):
    """The stream's last lists, which are those of s7."""
    out, source = _scratch(spark), f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # the table may be one file or a folder of parts
    events = spark.readStream.schema(schema).parquet(f"{source}*").select("user_id", F.col("event_type").alias("item"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("tie"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/lists/{batch_id:06d}")

    with _set(spark, "spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE):
        streams.stream_recent(events).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    lists = spark.read.option("recursiveFileLookup", "true").schema(f"{streams.RECENT}, batch int").parquet(f"{out}/lists")
    last = lists.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return lists.join(last, ["user_id", "batch"]).select("user_id", "item", "rank")


@query(f"""with popular as (select event_type as item from events group by 1 order by count(*) desc, 1 limit 2)
    select user_id, item, rank from (select user_id, item, row_number() over (partition by user_id order by rank)::int as rank from {_RECENT} where item not in (select item from popular)) where rank <= 4""")
def s9_recent_not_popular(spark, sf_dir):
    popular = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("item")).count().orderBy(F.desc("count"), "item").limit(2).select("item")
    return catalogue.recent_not_popular(_recent(spark, sf_dir), popular, "user_id", "item")


@query(r"""select p_partkey, regexp_replace(regexp_replace(replace(lower(p_name || ' & ' || p_type), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part""")
def s10_slug(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", catalogue.slug(F.concat_ws(" & ", "p_name", "p_type")).alias("slug"))


@query(f"""with h as (select page_id as hit_id, case page_id % 6 when 0 then '#' when 1 then '#browse' when 2 then '#category-brand-' || (11 + page_id % 40) when 3 then '#/' || page_id % 3000 when 4 then '#part-' || page_id else url end as hash from pages)
    , r as (select hit_id, regexp_replace(hash, '^#/?', '') as route from h)
    , c as (select 'category-' || replace(lower(category), '#', '-') as route, category as cat from {_CATEGORIES})
    , i as (select route, min(item) as item from (select id::varchar as route, id::varchar as item from {_CATALOGUE} union all select route, id::varchar from {_CATALOGUE}) group by route)
    , t as (select hit_id, cat, item, case when route in ('', 'dashboard') then 'dashboard' when route = 'browse' then 'browse' when cat is not null then 'category' when item is not null then 'item' else 'missing' end as type
        from r left join c using (route) left join i using (route))
    select hit_id, type, case type when 'category' then cat when 'item' then item end as target from t""")
def s11_classify_routes(spark, sf_dir):
    i = F.col("page_id")
    text_of = lambda c: c.cast("string")
    hash_ = (
        F.when(i % 6 == 0, "#").when(i % 6 == 1, "#browse").when(i % 6 == 2, F.concat(F.lit("#category-brand-"), text_of(11 + i % 40)))
        .when(i % 6 == 3, F.concat(F.lit("#/"), text_of(i % 3000))).when(i % 6 == 4, F.concat(F.lit("#part-"), text_of(i))).otherwise(F.col("url"))
    )
    hits = _table(spark, sf_dir, "pages").select(i.alias("hit_id"), hash_.alias("hash"))
    return catalogue.classify_routes(hits, _catalogue(spark, sf_dir), _categories(spark, sf_dir))


@query(f"""select 'unavailable' as rule, count(*) as violations from {_CATALOGUE} where status <> 'available'
    union all select 'repeated_route', count(*) from (select route from {_CATALOGUE} group by route having count(*) > 1)
    union all select 'unknown_category', count(*) from {_CATALOGUE} where category not in (select category from {_CATEGORIES})
    union all select 'banned_word', count(*) from {_CATALOGUE} where regexp_matches(lower(name), 'blue|red')""")
def s12_check_catalogue(spark, sf_dir):
    return catalogue.check_catalogue(_catalogue(spark, sf_dir), _categories(spark, sf_dir), "blue|red")


# --- page sets -------------------------------------------------------------------------------------------------------


def _pages(spark, sf_dir):
    """A page for every five lines of a document."""
    count = F.ceil(F.size(js.lines(F.col("text"))) / 5).cast("int")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), count - 1)).alias("page_idx"))
    return rows.withColumn("rotation", ((F.col("doc_id") + F.col("page_idx")) % 4 * 90).cast("int"))


_PAGES = r"""(select doc_id, page_idx::int as page_idx, ((doc_id + page_idx) % 4 * 90)::int as rotation from (select doc_id, unnest(range(0, ceil(len(regexp_split_to_array(text, '\r?\n')) / 5)::bigint)) as page_idx from documents))"""


@query("""with s as (select doc_id, doc_id % 8 as c, 4 + doc_id % 9 as n from documents)
    select doc_id, p::int as page_idx, true as ok, null as reason from s, lateral (select unnest(case c when 0 then [0, 1, 2, 4] when 1 then [1] when 2 then range(0, n) end) as p) where c = 0 and n >= 5 or c in (1, 2)
    union all select doc_id, null, false, 'out_of_range' from s where c = 0 and n < 5 or c in (3, 4, 7)
    union all select doc_id, null, false, 'empty' from s where c = 5
    union all select doc_id, null, false, 'bad_token' from s where c = 6""")
def p1_expand_ranges(spark, sf_dir):
    i, n = F.col("doc_id"), (4 + F.col("doc_id") % 9).cast("int")
    spec = F.element_at(F.array(F.lit("1-3, 5"), F.lit("2,, 2"), F.concat(F.lit("1-"), n.cast("string")), F.lit("0"), F.lit("3-1"), F.lit(" , "), F.lit("2,a"), F.lit("99999999999")), (i % 8 + 1).cast("int"))
    return pages.expand_ranges(_table(spark, sf_dir, "documents").select("doc_id", spec.alias("spec"), n.alias("page_count")), "doc_id")


def _picks(spark, sf_dir):
    return _pages(spark, sf_dir).where("(doc_id * 7 + page_idx) % 3 = 0")


_PICKS = f"(select * from {_PAGES} where (doc_id * 7 + page_idx) % 3 = 0)"


@query(f"select doc_id, page_idx, rotation, (row_number() over (partition by doc_id order by page_idx) - 1)::int as new_idx from {_PICKS}")
def p2_select_pages(spark, sf_dir):
    return pages.select_pages(_pages(spark, sf_dir), _picks(spark, sf_dir), "doc_id")


@query(f"""select doc_id, page_idx, (row_number() over (partition by doc_id order by page_idx) - 1)::int as new_idx, false as rejected from {_PAGES} where (doc_id * 7 + page_idx) % 3 <> 0
    union all select doc_id, null, null, true from {_PAGES} group by doc_id having bool_and((doc_id * 7 + page_idx) % 3 = 0)""")
def p3_drop_pages(spark, sf_dir):
    left, rejected = pages.drop_pages(_pages(spark, sf_dir), _picks(spark, sf_dir), "doc_id")
    return left.select("doc_id", "page_idx", "new_idx", F.lit(False).alias("rejected")).union(rejected.select("doc_id", F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(True)))


@query(f"select doc_id // 10 as bundle, (row_number() over (partition by doc_id // 10 order by -(doc_id % 10), doc_id, page_idx) - 1)::int as new_idx, doc_id, page_idx from {_PAGES}")
def p4_concat_documents(spark, sf_dir):
    bundle = _table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 10").alias("bundle"), (-(F.col("doc_id") % 10)).alias("ord"))
    return pages.concat_documents(_pages(spark, sf_dir), bundle, "doc_id")


@query(f"select doc_id, page_idx, 'Page ' || (page_idx + 1) as label from {_PAGES}")
def p5_number_pages(spark, sf_dir):
    return pages.number_pages(_pages(spark, sf_dir), "doc_id", "Page ")


@query(f"select doc_id, page_idx, case when (doc_id * 7 + page_idx) % 3 = 0 then (rotation + 270) % 360 else rotation end as rotation from {_PAGES}")
def p6_rotate_pages(spark, sf_dir):
    return pages.rotate_pages(_pages(spark, sf_dir), _picks(spark, sf_dir), "doc_id", 270)


# --- invoices --------------------------------------------------------------------------------------------------------

_MONEY = """(select *, l_extendedprice::decimal(14,2)::decimal(28,6) as p, (l_extendedprice::decimal(14,2) * l_discount::decimal(14,2))::decimal(28,6) as d,
    ((l_extendedprice::decimal(14,2) - (l_extendedprice::decimal(14,2) * l_discount::decimal(14,2))) * l_tax::decimal(14,2))::decimal(28,6) as t from lineitem)"""


@query(f"""select o_orderkey, c_name, round(sum(p), 2)::double as subtotal, round(sum(d), 2)::double as discount, round(sum(t), 2)::double as tax, round(sum(p) - sum(d) + sum(t), 2)::double as total
    from {_MONEY} join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by o_orderkey, c_name""")
def b1_invoice_totals(spark, sf_dir):
    return business.invoice_totals(*(_table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer")))


@query(f"""select l_tax, o_orderstatus, grouping(l_tax, o_orderstatus)::int as level, count(*) as lines, round(sum(p - d), 2)::double as net, round(sum(t), 2)::double as tax
    from {_MONEY} join orders on l_orderkey = o_orderkey group by cube(l_tax, o_orderstatus)""")
def b2_tax_summary(spark, sf_dir):
    return business.tax_summary(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem"))


_LINES = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"


@query(f"""select l_orderkey, line, ceil(line / 3)::int as page, carried from (select l_orderkey, (row_number() over ({_LINES}))::int as line,
    (sum(l_extendedprice::decimal(14,2)) over ({_LINES} rows between unbounded preceding and current row))::double as carried from lineitem)""")
def b3_invoice_pages(spark, sf_dir):
    return business.invoice_pages(_table(spark, sf_dir, "lineitem"), 3)


# --- files -----------------------------------------------------------------------------------------------------------


_FILES = """(select page_id, regexp_extract(url, '^[^?#]*') || case when page_id % 3 = 0 then '.HTML' else '' end as path, octet_length(encode(html)) as length from pages)"""


def _files(pages: DataFrame) -> DataFrame:
    """Pages as files: their urls without queries, some with an extension more, and the size of their markup."""
    ending = F.when(F.col("page_id") % 3 == 0, ".HTML").otherwise("")
    return pages.select("page_id", F.concat(F.regexp_extract("url", "^[^?#]*", 0), ending).alias("path"), F.octet_length("html").cast("long").alias("length"))


@query(f"select page_id, path, string_split(path, '/')[-1] as name, string_split(lower(string_split(path, '/')[-1]), '.')[-1] as ext, length from {_FILES}")
def i1_file_inventory(spark, sf_dir):
    return files.inventory_of(_files(_table(spark, sf_dir, "pages")))


def _uploads(spark, sf_dir):
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".txt", ".webp"))), (i % 4 + 1).cast("int"))
    mime = F.element_at(F.array(*map(F.lit, ("image/jpeg", "", "image/png", "application/octet-stream", "text/html"))), (i % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select(F.when(i % 23 != 0, F.col("source")).alias("batch_id"), F.lit("image").alias("kind"), F.concat(F.lit("f"), i.cast("string"), ext).alias("name"), mime.alias("mime"), F.col("n_chars").alias("size"), i.alias("doc_id"), "text")


_UPLOADS = """(select case when doc_id % 23 <> 0 then source end as batch_id, 'f' || doc_id || ['.jpg', '.PNG', '.txt', '.webp'][doc_id % 4 + 1] as name, ['.jpg', '.png', '.txt', '.webp'][doc_id % 4 + 1] as ext,
    ['image/jpeg', '', 'image/png', 'application/octet-stream', 'text/html'][doc_id % 5 + 1] as mime, n_chars as size, doc_id, text from documents)"""


@query(f"""with j as (select batch_id, name, case when doc_id % 19 = 0 then 'kind' when count(*) over (partition by batch_id) > 49 and batch_id < 'src15' then 'too_many' when mime = 'text/html' then 'type' when ext = '.txt' then 'extension' when size > 3000 then 'size' end as reason from {_UPLOADS})
    select batch_id, name, reason is null as ok, reason from j""")
def i2_admit(spark, sf_dir):
    few = F.col("batch_id") < "src15"
    limits = spark.createDataFrame([("few", 49, 3000, ["image/jpeg", "image/png", "image/webp"], ["jpg", "png", "webp"]), ("many", 2_000_000_000, 3000, ["image/jpeg", "image/png", "image/webp"], ["jpg", "png", "webp"])], files.LIMITS)
    uploads = _uploads(spark, sf_dir).withColumn("kind", F.when(F.col("doc_id") % 19 == 0, F.when(few, "unknown")).when(few, "few").otherwise("many"))
    return files.admit(uploads, limits).select("batch_id", "name", "ok", "reason")


@query(f"""select name, case when doc_id % 3 = 0 then 'JPEG' when doc_id % 3 = 1 then 'WebP' when mime = 'image/jpeg' then 'JPEG' when mime = 'image/png' then 'PNG' when ext = '.jpg' then 'JPEG' when ext = '.png' then 'PNG' when ext = '.webp' then 'WebP' else 'Unknown' end as format,
    case ext when '.jpg' then 'JPEG' when '.png' then 'PNG' when '.webp' then 'WebP' else 'Unknown' end as ext_format, format <> ext_format as mismatch from {_UPLOADS}""")
def i3_sniff_format(spark, sf_dir):
    uploads = _uploads(spark, sf_dir)
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFD8FFE0"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.unhex(F.lit("")))
    return files.sniff_format(uploads.withColumn("content", F.concat(head, F.encode("text", "UTF-8")))).select("name", "format", "ext_format", "mismatch")


@query("select c_custkey::varchar as c_custkey, c_name || ',\"x' || chr(10) || 'y' as note, '' as blank from customer")
def i4_read_delimited(spark, sf_dir):
    """Customers written as delimited text with awkward cells, and read back."""
    path = _scratch(spark)
    cells = [delimited.quoted(c) for c in (F.col("c_custkey"), F.concat(F.col("c_name"), F.lit(',"x\ny')), F.lit(None))]
    lined = _table(spark, sf_dir, "customer").select(F.concat_ws(",", *cells).alias("line"))
    spark.range(1).select(F.lit("c_custkey, note ,note").alias("line")).coalesce(1).write.text(f"{path}/header")
    lined.write.text(f"{path}/rows")
    back = delimited.read_delimited(spark, f"{path}/rows", header_path=f"{path}/header")
    return back.select("c_custkey", "note", F.col("note_2").alias("blank"))


@query("""select doc_id::varchar as "A", sha256(text || chr(10) || '"' || chr(13)) as text_sha256, coalesce(lang, '') as a_2 from documents""")
def i4_documents_back(spark, sf_dir):
    """Documents written as delimited text in parts, with line ends, quotes and names that differ in case only, and read back."""
    path = _scratch(spark)
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit('\n"\r')), "lang").toDF("number", "text", "tongue")
    rows.select(F.concat_ws(",", *(delimited.quoted(F.col(c)) for c in rows.columns)).alias("line")).write.text(f"{path}/rows")
    spark.range(1).select(F.lit('A,"te`xt",a').alias("line")).coalesce(1).write.text(f"{path}/header")
    back = delimited.read_delimited(spark, f"{path}/rows", header_path=f"{path}/header", raw_names=False)
    return back.select("A", F.sha2("`te``xt`", 256).alias("text_sha256"), "a_2")


@query("""select p_partkey, p_partkey || ',"' || replace(p_name || ', "' || p_brand || '"', '"', '""') || '",' || p_type as line from part""")
def o1_delimited_lines(spark, sf_dir):
    part = _table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')))
    return delimited.delimited_lines(part, "p_partkey", ["p_partkey", "name", "p_type"])


@query(r"""with n as (select source, doc_id, (row_number() over (partition by source order by doc_id))::varchar as k, 'a b/My file ' || doc_id % 100 || '?.v1.txt' as name from documents)
    , o as (select source, doc_id, case when length(k) < 2 then '0' || k else k end || '-My-file-' || doc_id % 100 || '-.v1-small.jpg' as out_name from n)
    select source, doc_id, out_name, count(*) over (partition by out_name) > 1 as collision from o""")
def o2_export_manifest(spark, sf_dir):
    named = _table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("a b/My file "), (F.col("doc_id") % 100).cast("string"), F.lit("?.v1.txt")).alias("name"))
    return files.export_manifest(named, "source", "doc_id", "name", "jpg", "small")


def _outputs(spark, sf_dir):
    i = F.col("doc_id")
    kinds = F.element_at(F.array(*map(F.lit, ("json", "csv", "text"))), (i % 3 + 1).cast("int"))
    body = F.when(i % 3 == 0, F.concat(F.lit('{ "n" : '), F.col("n_chars").cast("string"), F.when(i % 5 == 0, "").otherwise(" }"))).otherwise(F.col("text"))
    return _table(spark, sf_dir, "documents").select(F.when(i % 11 == 0, "exe").otherwise(kinds).alias("kind"), F.concat(F.lit('d"'), i.cast("string")).alias("name"), body.alias("body"))


_OUTPUTS = """(select doc_id, case when doc_id % 11 <> 0 then ['json', 'csv', 'text'][doc_id % 3 + 1] end as kind, doc_id % 11 <> 0 and (doc_id % 3 <> 0 or doc_id % 5 <> 0) as good, 'd"' || doc_id as name,
    case when doc_id % 3 = 0 then '{"n":' || n_chars || '}' else text end as body from documents)"""


@query(f"""select kind, case kind when 'json' then 'application/json' when 'csv' then 'text/csv' when 'text' then 'text/plain' end as mime, count(*) filter (good) as files, coalesce(sum(octet_length(encode(body))) filter (good), 0)::bigint as bytes,
    count(*) filter (not good) as rejected from {_OUTPUTS} group by kind""")
def o3_write_outputs(spark, sf_dir):
    return files.write_outputs(_outputs(spark, sf_dir), _scratch(spark)).select("kind", "mime", "files", "bytes", "rejected")


@query(f"select kind, name, sha256(body) as body_sha256 from {_OUTPUTS} where good")
def o3_outputs_back(spark, sf_dir):
    """What a second run over the same folder leaves: its outputs once."""
    path = _scratch(spark)
    for _ in range(2):
        files.write_outputs(_outputs(spark, sf_dir), path)
    return files.read_outputs(spark, path).select("kind", "name", F.sha2("body", 256).alias("body_sha256"))


# a TIFF block with an orientation, a camera, an unknown tag, an exposure and a position, made by the format's rules
_TIFF = (
    "4D4D002A00000008" "0006" "010F000200000005000000C8" "01120003000000010006" "0000" "0131000200000004" "4C6F6F00" "8769000400000001" "00000056" "8825000400000001" "00000080" "BEEF000300000002" "00010002" "00000000"
    "0003" "829A000500000001" "000000D0" "920A000500000001" "000000D8" "9202000500000001" "000000E0" "00000000"
    "0004" "0001000200000002" "53000000" "0002000500000003" "000000E8" "0003000200000002" "45000000" "0004000500000003" "00000100" "00000000"
)
_TIFF_DATA = "41636D6500000000" "0000000A000007D0" "0000003200000001" "00003699" "00002710" "0000000C00000001" "0000002200000001" "0000000000000000" "0000003800000001" "0000000700000001" "0000001E00000002"
TIFF = _TIFF.ljust(2 * 0xC8, "0") + _TIFF_DATA


def _images(spark, sf_dir):
    """Image files made of the documents: PNG with texts, an EXIF block or 100 text chunks, JPEG and WebP with EXIF and XMP, and
    files that are cut off or no images."""
    word = lambda t: F.encode(F.lit(t), "UTF-8")
    hexed = lambda t: F.unhex(F.lit(t))
    size = lambda b: F.unhex(F.lpad(F.hex(F.length(b).cast("long")), 8, "0"))
    png_chunk = lambda kind, body: F.concat(size(body), word(kind), body, hexed("00000000"))
    body = F.concat(word("Comment"), hexed("00"), F.encode(F.regexp_replace("text", r"[^\x20-\x7E]", "."), "UTF-8"))
    start, end = hexed("89504E470D0A1A0A"), hexed("0000000049454E4400000000")
    many = hexed("".join(f"00000004{b'tEXt'.hex()}{b'k'.hex()}00{f'{n:02d}'.encode().hex()}00000000" for n in range(100)))
    packet = F.concat(F.lit('<x xmp:CreatorTool="'), F.col("source"), F.lit('" tiff:Make=\'Acme\'><dc:creator><rdf:Seq><rdf:li> A B </rdf:li>'))
    xmp, exif = F.encode(packet, "UTF-8"), hexed(TIFF)
    segment = lambda marker, b: F.concat(hexed("FFFF" + marker), F.substring(F.unhex(F.lpad(F.hex((F.length(b) + 2).cast("long")), 4, "0")), 1, 2), b)
    jpeg = F.concat(hexed("FFD8"), segment("E0", word("JFIF")), segment("E1", F.concat(word("Exif"), hexed("0000"), exif)), segment("E1", F.concat(word("http://ns.adobe.com/xap/1.0/"), hexed("00"), xmp)), segment("ED", word("8BIM")), hexed("FFD9"))
    little = lambda b: F.concat(*(F.substring(size(b), k, 1) for k in (4, 3, 2, 1)))
    riff = lambda kind, b: F.concat(word(kind), little(b), b, F.when(F.length(b) % 2 == 1, hexed("00")).otherwise(hexed("")))
    webp = F.concat(word("RIFF"), hexed("00000000"), word("WEBP"), riff("VP8X", hexed("2C" + "00" * 9)), riff("EXIF", exif), riff("XMP ", xmp), riff("ICCP", word("icc")))
    text_png = F.concat(start, png_chunk("tEXt", body), png_chunk("pHYs", hexed("00000B130000000A01")), png_chunk("tIME", word("1234567")), end)
    kinds = [text_png, F.substring(text_png, 1, 30), F.concat(start, png_chunk("eXIf", exif), end), F.concat(start, many, end), jpeg, webp, F.encode("text", "UTF-8")]
    content = F.element_at(F.array(*kinds), (F.col("doc_id") % len(kinds) + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), content.alias("content"))


def _exif_rows(kind: str) -> list[tuple]:
    gps = "EXIF GPS location"
    return [
        ("EXIF", "container", "EXIF", kind, None, None), (None, "EXIF image", "Camera make", "Acme", None, None), (None, "EXIF image", "Orientation", "6", "6", "1"), (None, "EXIF image", "Software", "Loo", None, None),
        (None, "EXIF image", "Tag 0xbeef", "1, 2", "1,2", "1,1"), (None, "EXIF camera", "Exposure time", "10/2000", "10", "2000"), (None, "EXIF camera", "Focal length", "50/1", "50", "1"),
        (None, "EXIF camera", "Aperture", "13977/10000", "13977", "10000"), (None, gps, "Latitude ref", "S", None, None), (None, gps, "Latitude", "12/1, 34/1, 0/0", "12,34,0", "1,1,0"),
        (None, gps, "Longitude ref", "E", None, None), (None, gps, "Longitude", "56/1, 7/1, 30/2", "56,7,30", "1,1,2"), (None, "warning", "warning", media.GPS_FOUND, None, None),
    ]


def _rows_sql(remainder: int, rows: list[tuple]) -> str:
    said = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)
    return f"""select 'p' || doc_id as path, v.* from documents, (values {values}) as v(container, grp, label, value, num, den) where doc_id % 7 = {remainder}"""


_XMP_SQL = lambda n: f"""select 'p' || doc_id as path, null as container, 'XMP' as grp, unnest(['Creator tool', 'Camera make', 'Author']) as label, unnest([source, 'Acme', 'A B']) as value, null as num, null as den
    from documents where doc_id % 7 = {n}"""  # noqa: E731
_MEDIA_SQL = " union all ".join([
    r"select 'p' || doc_id as path, null as container, 'PNG tEXt' as grp, 'Comment' as label, trim(regexp_replace(text, '[^\x20-\x7E]', '.', 'g')) as value, null as num, null as den from documents where doc_id % 7 = 0",
    _rows_sql(0, [("PNG text", "container", "PNG text", "tEXt chunk", None, None), ("Pixel density", "container", "Pixel density", "PNG pHYs chunk", None, None), ("Timestamp", "container", "Timestamp", "PNG tIME chunk", None, None),
        (None, "PNG density", "Pixels per unit X", "2835", None, None), (None, "PNG density", "Pixels per unit Y", "10", None, None), (None, "PNG density", "Unit", "Meter", None, None)]),
    _rows_sql(1, [(None, "warning", "warning", media.NOTHING_FOUND, None, None)]), _rows_sql(2, _exif_rows("PNG eXIf chunk")),
    _rows_sql(3, [("PNG text", "container", "PNG text", "tEXt chunk", None, None)] * 100 + [(None, "PNG tEXt", "k", f"{n:02d}", None, None) for n in range(100)]),
    _rows_sql(4, [*_exif_rows("JPEG APP1 EXIF block"), ("APP0", "container", "APP0", "JPEG application segment 0xe0", None, None), ("XMP", "container", "XMP", "JPEG APP1 XMP block", None, None),
        ("Photoshop/IPTC", "container", "Photoshop/IPTC", "JPEG APP13 metadata block", None, None)]), _XMP_SQL(4),
    _rows_sql(5, [*_exif_rows("WebP EXIF chunk"), ("XMP", "container", "XMP", "WebP XMP chunk", None, None), ("ICC profile", "container", "ICC profile", "WebP ICCP chunk", None, None),
        *((None, "WebP container", f"{c} flag", "Present", None, None) for c in ("ICC profile", "EXIF", "XMP"))]), _XMP_SQL(5),
    _rows_sql(6, [(None, "warning", "warning", media.UNSUPPORTED, None, None), (None, "warning", "warning", media.NOTHING_FOUND, None, None)]),
])


@query(f"select *, grp = 'EXIF GPS location' as sensitive from ({_MEDIA_SQL})")
def m1_image_metadata(spark, sf_dir):
    items = media.image_metadata_items(_images(spark, sf_dir))
    return items.select("path", "container", "grp", "label", "value", F.array_join("num", ",").alias("num"), F.array_join("den", ",").alias("den"), "sensitive")


@query(f"""select path, bool_or(container = 'EXIF') is true as has_exif, bool_or(grp = 'EXIF GPS location') as has_gps, bool_or(grp = 'EXIF camera') as has_camera, bool_or(label = 'Software') as has_software,
    bool_or(container = 'XMP') is true as has_xmp, bool_or(container = 'ICC profile') is true as has_icc, bool_or(container = 'PNG text') is true as has_png_text, bool_or(grp = 'container' and starts_with(value, 'WebP')) as has_webp,
    count(*) filter (grp <> 'warning') + count(*) filter (label = 'Latitude') as metadata_count, count(*) filter (grp = 'warning') as warnings from ({_MEDIA_SQL}) group by path""")
def m2_privacy_flags(spark, sf_dir):
    images = _images(spark, sf_dir)
    return media.privacy_flags(images, media.image_metadata_items(images))


def _items(spark, sf_dir):
    """Metadata items made of the parts: a camera, exposures and a position for each. The parts are dealt out first, as a task of a
    small file of parts would make a great many items."""
    k = F.col("p_partkey")
    rat = lambda *x: F.array(*(F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in x))
    row = lambda grp, label, value, num=None, den=None: F.struct(F.lit(grp).alias("grp"), F.lit(label).alias("label"), value.cast("string").alias("value"), (num if num is not None else F.lit(None).cast("array<long>")).alias("num"), (den if den is not None else F.lit(None).cast("array<long>")).alias("den"))
    gps = "EXIF GPS location"
    rows = F.array(
        row("EXIF image", "Camera make", F.col("p_brand")), row("EXIF image", "Camera model", F.element_at(F.split("p_type", " "), 1)), row("EXIF camera", "Exposure time", F.lit("n/d"), rat(1), rat(k % 500 + 2)),
        row("EXIF camera", "F number", F.lit("n/d"), rat(k % 3000 + 1000), rat(999)), row("EXIF camera", "Exposure bias", F.lit("n/d"), rat(k % 7 - 3), rat(k % 2)), row("EXIF camera", "Lens specification", F.lit("n/d, n/d"), rat(k % 50, 7), rat(4, 2)),
        row("EXIF camera", "ISO speed", (k % 8 * 100), rat(k % 8 * 100), rat(1)), row(gps, "Latitude ref", F.when(k % 2 == 0, "N").otherwise("S")), row(gps, "Latitude", F.lit("n/d"), rat(k % 90, k % 60, 30), rat(1, 1, k % 2)),
        row(gps, "Longitude ref", F.lit("E")), row(gps, "Longitude", F.lit("n/d"), rat(k % 180, 0, 0), rat(1, 1, 1)),
    )
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type").repartition("p_partkey")
    return parts.select(k.cast("string").alias("path"), F.explode(rows).alias("r")).select("path", "r.*")


@query("""select p_partkey::varchar as path, round(case when p_partkey % 2 = 0 then 1 else -1 end * (p_partkey % 90 + (p_partkey % 60) / 60 + case when p_partkey % 2 = 1 then 30.0::double / 3600 else 0 end), 6) as lat, (p_partkey % 180)::double as lon from part""")
def m3_gps_points(spark, sf_dir):
    return media.gps_points(_items(spark, sf_dir))


_POINTS = """(select case when p_partkey % 100 = 0 then 90 * (p_partkey // 100 % 2 * 2 - 1) when p_partkey % 31 = 0 then null else (p_partkey * 37 % 18001) / 100 - 90 end as lat, case when p_partkey % 37 = 0 then 180 else (p_partkey * 53 % 36001) / 100 - 180 end as lon from part)"""


@query(f"""with p as (select lat is not null as known, case when lat is not null then least(floor(lat), 89) end as s, case when lat is not null then floor(case when abs(lat) = 90 or lon = 180 then -180 else lon end) end as w from {_POINTS})
    select case when known then side else 0 end::int as side, (floor(s / side) * side)::int as south, (floor(w / side) * side)::int as west, count(*) as files from p, (values (30), (10), (1)) as g(side) where known or side = 1 group by all""")
def m3_gps_grid(spark, sf_dir):
    """Points spread over the globe, with both poles, the date line and some without a latitude."""
    k = F.col("p_partkey")
    lat = F.when(k % 100 == 0, 90.0 * (F.floor(k / 100) % 2 * 2 - 1)).when(k % 31 == 0, None).otherwise(k * 37 % 18001 / 100 - 90)
    lon = F.when(k % 37 == 0, 180.0).otherwise(k * 53 % 36001 / 100 - 180)
    return media.gps_grid(_table(spark, sf_dir, "part").select(k.cast("string").alias("path"), lat.alias("lat"), lon.alias("lon")))


_SHORT = lambda x: f"regexp_replace(printf('%.2f', {x}::double), '[.]?0+$', '')"


@query(f"""select p_partkey::varchar as path, 'Exposure time' as label, '1/' || (p_partkey % 500 + 2) || ' sec' as display from part
    union all select p_partkey::varchar, 'ISO speed', (p_partkey % 8 * 100)::varchar from part
    union all select p_partkey::varchar, 'F number', 'f/' || {_SHORT('(p_partkey % 3000 + 1000) / 999')} from part
    union all select p_partkey::varchar, 'Exposure bias', case when p_partkey % 2 = 0 then '0' else (p_partkey % 7 - 3)::varchar end || ' (' || (p_partkey % 7 - 3) || '/' || p_partkey % 2 || ')' from part
    union all select p_partkey::varchar, 'Lens specification', {_SHORT('p_partkey % 50 / 4')} || ', 3.5' from part""")
def m4_format_exif(spark, sf_dir):
    return media.format_exif(_items(spark, sf_dir).where("grp = 'EXIF camera'"))


@query("select p_brand as make, string_split(p_type, ' ')[1] as model, null as software, count(*) as files, count(*) as with_gps from part group by 1, 2")
def m5_device_summary(spark, sf_dir):
    return media.device_summary(_items(spark, sf_dir))


@query(f"""select name, size, reason is null as ok, reason from (select string_split(path, '/')[-1] as name, length as size,
    case when string_split(lower(string_split(path, '/')[-1]), '.')[-1] <> 'html' then 'extension' when length > 4000 then 'size' end as reason from {_FILES})""")
def i6_stream_admit(spark, sf_dir):
    """The pages as a stream of uploads."""
    out, source = _scratch(spark), f"{sf_dir}/pages.parquet"
    # the table may be one file or a folder of parts
    rows = _files(spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*"))
    limits = spark.createDataFrame([("page", 2_000_000_000, 4000, [], ["html"])], files.LIMITS)
    streams.admit_rows(rows, limits, "page", f"{out}/files", f"{out}/checkpoint").awaitTermination()
    schema = "batch_id string, kind string, name string, mime string, size long, path string, ok boolean, reason string"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/files").select("name", "size", "ok", "reason")

"""Queries on texts: statistics, cleanup, minification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .base import LEAN, _page, _sql_list, _worded, _worded_sql, query, read
LINES = "string_split(regexp_replace(text, '\\n$', ''), chr(10))"
ROWS = f"list_transform({LINES}, lambda x: trim(x))"


@query(f"""select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as words,
 len(list_filter({ROWS}, lambda x: starts_with(x, '#'))) as headings,
 len(list_filter({ROWS}, lambda x: starts_with(x, '- ') or regexp_matches(x, '^[0-9]+\\. '))) as list_items,
 len(list_filter({ROWS}, lambda x: x <> '' and strlen(x) < 35)) as short_lines,
 len(string_split(text, '](')) - 1 as links, strlen(text) as bytes from documents""")
def doc_text_stats(spark, sf_dir):
    s = T.stats(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", *[s[n].alias(n) for n in ("words", "headings", "list_items", "short_lines", "links", "bytes")])


@query(f"""select doc_id, len(list_filter({LINES}, lambda x: {" or ".join(f"contains(x, {_sql_list([p])})" for p in V.PRICE_PHRASES)})) as price_lines,
 len(list_filter({LINES}, lambda x: {" or ".join(f"contains(lower(x), {_sql_list([p])})" for p in V.SPEC_PHRASES)})) as spec_lines from documents""")
def doc_price_spec_markers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.price_lines(F.col("text")).alias("price_lines"), T.spec_lines(F.col("text")).alias("spec_lines"))


@query(f"""with s as (select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as w, len(list_filter({ROWS}, lambda x: starts_with(x, '#'))) as h,
 len(list_filter({ROWS}, lambda x: starts_with(x, '- ') or regexp_matches(x, '^[0-9]+\\. '))) as l, len(list_filter({ROWS}, lambda x: x <> '' and strlen(x) < 35)) as s, len(string_split(text, '](')) - 1 as k,
 len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '')) as p, len(list_filter({LINES}, lambda x: {" or ".join(f"contains(x, {_sql_list([p])})" for p in V.PRICE_PHRASES)})) as m,
 len(list_filter({LINES}, lambda x: {" or ".join(f"contains(lower(x), {_sql_list([p])})" for p in V.SPEC_PHRASES)})) as c from documents)
select doc_id, 12 * h + 4 * l - s as docs, 14 * p + w // 20 - 2 * k as article, 16 * h + 12 * l + 40 * m + 22 * c - 4 * k as product, 10 * p + 2 * k - s as listing, 8 * p + 3 * k - 4 * h as search, 16 * p + w // 30 - 3 * k as forum from s""")
def doc_family_adjustment(spark, sf_dir):
    found = T.family_adjustment(T.stats(F.col("text")), T.price_lines(F.col("text")), T.spec_lines(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", *[found[n].alias(n) for n in ("docs", "article", "product", "listing", "search", "forum")])


@query(r"""select doc_id, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r]+(\n|$)', '\1', 'g'), '\n{3,}', chr(1), 'g'), '\n\n', chr(10), 'g'), chr(1), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') as clean from documents""")
def doc_cleanup(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.cleanup(F.col("text")).alias("clean"))


TOKENS = "concat(text, ' ', repeat('ab1', 20), ' ', sha2(text, 256), ' ', repeat('QUJD', 25), '=')"
SQL_TOKENS = "text || ' ' || repeat('ab1', 20) || ' ' || sha256(text) || ' ' || repeat('QUJD', 25) || '='"
SHORT = """case when regexp_full_match({0}, '[A-Za-z0-9+/=]{{80,}}') then '[BASE64_TRUNCATED]' when regexp_full_match({0}, '[0-9a-fA-F]{{40,64}}') then '[SHA_TRUNCATED]' else {0} end"""


@query(f"""select doc_id, array_to_string(list_transform(string_split({SQL_TOKENS}, ' '), lambda t: array_to_string(list_transform(string_split(t, chr(10)), lambda u: {SHORT.format("u")}), chr(10))), ' ') as short from documents""")
def doc_token_truncate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.shorten_tokens(F.expr(TOKENS)).alias("short"))


#: White space runs with chr(1) for two or more line breaks and chr(2) for one.
PACKED = r"regexp_replace(regexp_replace(regexp_replace({0}, '[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*', chr(1), 'g'), '[ \t\r]*\n[ \t\r]*', chr(2), 'g'), '[ \t\r]+', ' ', 'g')"
UNPACKED = "replace(replace({0}, chr(1), chr(10) || chr(10)), chr(2), chr(10))"


@query(f"select doc_id, {UNPACKED.format(PACKED.format('text'))} as packed from documents")
def doc_collapse_space(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.collapse_space(F.col("text")).alias("packed"))


#: (label, target) pairs of words, shown as links one after the other.
PAIRS_SQL = "[{'l': w0, 'h': '#' || w1}, {'l': w2, 'h': 'https://e.com/' || w3}, {'l': 'https://' || w4, 'h': 'https://' || w4}, {'l': w5, 'h': w6 || '/p.html'}, {'l': w7, 'h': 'mailto:' || w0}, {'l': w1, 'h': '/' || w2}, {'l': '', 'h': 'x'}, {'l': w3, 'h': ''}, {'l': 'é' || w4, 'h': '../ü'}]"


@query(_worded_sql(8) + f"""select doc_id, array_to_string(list_transform({PAIRS_SQL}, lambda x: case when x.l <> '' and x.h <> '' and (x.h like '#%' or x.l = x.h or (not contains(x.h, '://') and x.h not like '/%' and x.h not like 'mailto:%')) then x.l else '[' || x.l || '](' || x.h || ')' end), ' [note] ') as made from t""")
def doc_link_simplify(spark, sf_dir):
    text = _page("[{w0}](#{w1}) [note] [{w2}](https://e.com/{w3}) [note] [https://{w4}](https://{w4}) [note] [{w5}]({w6}/p.html) [note] [{w7}](mailto:{w0}) [note] [{w1}](/{w2}) [note] [](x) [note] [{w3}]() [note] [é{w4}](../ü)")
    return _worded(spark, sf_dir, 8).select("doc_id", T.simplify_links(text).alias("made"))


@query("select conv_id, turn, strlen(text) > 20 and len(string_split(text, ' ')) > 2 as leaf from conversations")
def doc_json_leaf_strings(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_leaf(F.col("text")).alias("leaf"))


@query(_worded_sql(6) + """select doc_id, '# ' || w0 || chr(10) || w1 || ' ' || w2 || chr(10) || chr(10) || '```py' || chr(10) || '  a  ' || w3 || '   [x](#y)' || chr(10) || 'Copy item path' || chr(10) || '```' || chr(10) || w4 || ' `' || w5 || '`' as made from t""")
def doc_minify_fences(spark, sf_dir):
    text = _page("# {w0}[§](#a)  \n  Copy item path\n{w1}   [{w2}](#z) \n\n\n\n```py\n  a  {w3}   [x](#y)\nCopy item path\n```\nExpand description\n{w4}\t `{w5}`  \n\n")
    return _worded(spark, sf_dir, 6).select("doc_id", T.minify(text).alias("made"))


@query(f"""with a as (select doc_id, text, {PACKED.format("text || chr(10)")} as packed from documents), b as (select doc_id, text, array_to_string(list_transform(string_split(replace(replace(packed, chr(1), ' ' || chr(1) || ' '), chr(2), ' ' || chr(2) || ' '), ' '), lambda t: {SHORT.format("t")}), ' ') as t from a),
c as (select doc_id, text, regexp_replace(regexp_replace({UNPACKED.format("replace(replace(t, ' ' || chr(1) || ' ', chr(1)), ' ' || chr(2) || ' ', chr(2))")}, '[ \\t\\r\\n]+$', ''), '^\\n+', '') as made from b)
select doc_id, case when strlen(made) > strlen({LEAN.format("text")}) then {LEAN.format("text")} else made end as minified from c""")
def doc_minify(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.minify(F.col("text")).alias("minified"))

"""The training-data queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, license_scan, quality, simhash, suffix_dedup, token_counts, url_filter, warc
from .shared import table, written


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_matches(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["first"])
    labels = F.transform("places", lambda p: p["label"])
    more = F.transform("blocks", lambda b: b["label"])
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, more)).alias("labels"),
        score.alias("score"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.read_back(written(chat.windows(rows.unionByName(own)), "formatted"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    distances = [F.round(c, 6).alias(c) for c in ("class_distance", "common_distance")]
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *distances)


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_suffix_dedup, op3_warc, op4_token_counts, op5_chat_formatting, op6_url_filter, op7_benchmark_decontamination, op8_simhash_near_dedup, op9_quality_rules, op10_bpe_encode_decode)}


OP5_SQL = """
with probe(conv_id, turn, role, text) as (values
  (-1::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
r0 as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (
    select conv_id, turn, role, text from conversations union all select * from probe)),
e1 as (select *, replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
    '%', '%25'), '<|', '<%7C'), '|>', '%7C>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]'), '<s>', '%3Cs>'), '</s>', '%3C/s>'),
    '<<SYS>>', '%3C%3CSYS>>'), '<</SYS>>', '%3C%3C/SYS>>') as safe from r0),
t0 as (select *, length(safe) + length(role) + 17 as chars, cast(ceil((strlen(safe) + strlen(role) + 17) / 4.0) as bigint) as tokens from e1),
t1 as (select *, row_number() over w - 1 as seq, coalesce(sum(tokens) over (w rows between unbounded preceding and 1 preceding), 0) as before
  from t0 window w as (partition by conv_id order by turn nulls first, role, text)),
t as (select *, 2 * cast(floor(before / 256.0) as bigint) + case when tokens > 256 then 1 else 0 end as win from t1),
sys as (select conv_id, tokens as sys from t where seq = 0 and role = 'system'),
f as (select t.conv_id, win, min(seq) as first_seq, min(before) as first_before, sum(tokens) as own from t group by all),
g as (select f.*, sys.sys from f left join sys on sys.conv_id is not distinct from f.conv_id),
again as (
  select g.conv_id, g.win, t.seq, t.chars from g join t on t.conv_id is not distinct from g.conv_id and (
    (t.seq < g.first_seq and t.seq >= g.first_seq - 2 and (t.seq > 0 or g.sys is null)
      and g.first_before - t.before <= least(256, 1024 - g.own - coalesce(g.sys, 0)))
    or (t.seq = 0 and t.role = 'system' and g.first_seq > 0))),
more as (select conv_id, sum(chars) as chars from again group by conv_id),
sums as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by seq)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by seq) filter (role = 'assistant'), '')) as loss_sha256, sum(chars) as chars
  from t group by conv_id)
select s.conv_id, s.n_turns, s.turns_sha256, cast(s.loss_chars as bigint) as loss_chars, s.loss_sha256,
  cast(s.chars + coalesce(m.chars, 0) as bigint) as formatted_chars
from sums s left join more m on m.conv_id is not distinct from s.conv_id
"""


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select html, min(page_id) as first_id from p group by html),
h as (select p.*, f.first_id, sha1(p.html) as hex from p join f using (html)),
b as (select *, list_reduce(list_transform(string_split(hex, ''), lambda x:
  ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', x)]),
  lambda a, c: a || c) as bits from h)
select page_id, strlen(html)::bigint as payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5),
    lambda j: (substr(bits, cast(5 * i + j + 1 as bigint), 1)::bigint) << (4 - j)))::bigint, 1)), lambda a, c: a || c) as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from b
"""




def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op1_sql() -> str:
    """The license scan without its filters: every template is compared with every block."""
    rows = []
    for t in license_scan.templates():
        words = [w.decode() for w in (t.words if t.phrase else sorted(set(t.words)))]
        stride = max(license_scan.STRIDE, 1 << (len(t.words) - 1).bit_length())
        rows.append(f"({_text(t.label)}, {str(t.phrase).lower()}, {stride}, {t.need}, [{', '.join(map(_text, words))}])")
    return rf"""
with t(label, phrase, stride, need, words) as (values {', '.join(rows)}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (select *, row_number() over () as row from d),
f as (select row, ws, label, words, unnest(list_filter(range(1, len(ws) + 1), lambda n: ws[n] = words[1])) as n from i, t where phrase),
p as (select row, label, n - 1 as start from f where ws[n : n + len(words) - 1] = words),
b as (select row, label, need, len(words) as size, len(list_intersect(words, ws[n * stride + 1 : (n + 2) * stride])) as shared from (select row, ws, label, words, need, stride, unnest(range(0, len(ws) // stride + 1)) as n from i, t where not phrase)),
m as (select row, label, shared / size::double as share from b where shared >= need),
base as (select row, count(*) as n_base, min(start) as first_word, max(start) as last_word, array_to_string(list_sort(list(distinct label)), ',') as base_labels from p group by 1),
every as (select row, array_to_string(list_sort(list(distinct label)), ',') as labels, max(share) as best from (select row, label, 1.0::double as share from p union all select * from m) group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(best, 0.0)::double as score
from i left join base using (row) left join every using (row)
"""


OP2_SQL = """
with d as (select doc_id, row_number() over () as row, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
l as (select row, h, length(h) // 2 - 199 as n from d where length(h) >= 400),
c as (select row, n, h, unnest(range(0, (n + 499) // 500)) as part from l),
p as (select row, 500 * part as low, least(500, n - 500 * part) as size, substr(h, 1000 * part + 1, 1398) as bytes from c),
s as (select row, low, bytes, unnest(range(0, size)) as j from p),
k as (select row, low + j as i, md5(substr(bytes, 2 * j + 1, 400)) as m from s),
x as (select row, i from k where m in (select m from k group by m having count(*) > 1)),
g as (select row, i, coalesce(i > lag(i) over w + 200, true) as fresh from x window w as (partition by row order by i)),
n as (select row, i, sum(fresh::int) over (partition by row order by i) as span from g),
r as (select row, span, min(i) as a, max(i) + 200 as z from n group by 1, 2),
q as (select row, a, z, coalesce(lag(z) over (partition by row order by a), 0) as before from r),
o as (select row, count(*) as n_spans, sum(z - a) as n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) as rest from q join d using (row) group by 1)
select doc_id, strlen(text)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256 from d left join o using (row)
"""


def op9_sql() -> str:
    """Counts, references and distances of the quality rules, with windows as strings."""
    known = " ".join(f"when '{lang}' then [{', '.join(map(_text, words))}]" for lang, words in quality.COMMON.items())
    n = len(quality.COMMON["en"])
    js = "sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: case when {p}[i] > 0 then 0.5 * {p}[i] * log2(2 * {p}[i] / ({p}[i] + {q}[i])) else 0 end + case when {q}[i] > 0 then 0.5 * {q}[i] * log2(2 * {q}[i] / ({p}[i] + {q}[i])) else 0 end))))"
    count = lambda c: f"length(regexp_replace(joined, '{c}', '', 'g'))"
    return rf"""
with d as (select doc_id, lang, row_number() over () as row, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') as ws, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') as ls, case lang {known} end as own from d),
j as (select *, array_to_string(ws, '') as joined from w),
c as (select *, length(joined) as chars, [length(joined) - {count('[A-Z]')}, length(joined) - {count('[0-9]')}, length(joined) - {count("[.,;:!?''" + '"' + "()-]")}, length(joined) - {count('[#*$%&|<>]')}] as four, {count('[\\x00-\\x7F]+')} as wide from j),
win as (select row, n, array_to_string(ws[n : n + 7], ' ') as t from (select row, ws, unnest(range(1, greatest(1, len(ws) - 6))) as n from c)),
twice as (select row, n, count(*) over (partition by row, t) as k from win),
cover as (select row, count(distinct n + o) as covered from twice, (select unnest(range(0, 8)) as o) where k > 1 group by 1),
m as (select c.*, len(ws) as n_words, coalesce(covered, 0) as n_repeat, len(ws) < 20 or 100 * coalesce(covered, 0) > 30 * len(ws) as base_failed,
 list_transform(four || [chars - wide - list_sum(four), wide], lambda v: case when chars > 0 then v / chars::double else 0 end) as p,
 list_transform(own, lambda v: case when len(ws) > 0 then len(list_filter(ws, lambda x: x = v)) / len(ws)::double else 0 end) as ps from c left join cover using (row)),
e as (select *, ps || [greatest(0, 1 - list_sum(ps))] as pc from m),
q1 as (select lang, {', '.join(f'avg(p[{i}]) as a{i}' for i in range(1, 7))} from e where not base_failed and n_words >= {quality.MIN_CLASS_WORDS} group by 1),
q2 as (select lang, {', '.join(f'avg(pc[{i}]) as b{i}' for i in range(1, n + 2))} from e where not base_failed and n_words >= {quality.MIN_COMMON_WORDS} and own is not null group by 1),
r as (select e.*, case when q1.a1 is not null then [{', '.join(f'a{i}' for i in range(1, 7))}] end as qa, case when b1 is not null then [{', '.join(f'b{i}' for i in range(1, n + 2))}] end as qb
 from e left join q1 on q1.lang is not distinct from e.lang left join q2 on q2.lang is not distinct from e.lang),
z as (select *, case when n_words >= {quality.MIN_CLASS_WORDS} and qa is not null then {js.format(p='p', q='qa')} end as da, case when n_words >= {quality.MIN_COMMON_WORDS} and qb is not null and own is not null then {js.format(p='pc', q='qb')} end as db from r)
select doc_id, n_words::bigint as n_words, chars::bigint as word_chars, four[4]::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, n_repeat::bigint as n_repeat_words, base_failed,
 not base_failed and coalesce(da, 0) <= {quality.MAX_CLASS_DISTANCE} and coalesce(db, 0) <= {quality.MAX_COMMON_DISTANCE} as kept, round(da, 6) as class_distance, round(db, 6) as common_distance from z
"""


def op6_sql() -> str:
    """Rules, exact n-gram counts of accepted and rejected texts, and the cut between the held-out ones."""
    u = url_filter
    n = u.ORDERS
    rules = ", ".join(f"({_text(r)}, {_text(r.split('/', 1)[0])}, {_text('/' + r.split('/', 1)[1])}, {_text(v)})" for v, r in u.RULES)
    each = " union all ".join(f"select row, i, {k} as k, substr(padded, i + {n - 1 - k}, {k + 1}) as gram, substr(padded, i + {n - 1 - k}, {k}) as context from c" for k in range(n))

    def chance(cls: str) -> str:
        p = "(1 / 256.0::double)"
        for k in range(n):
            p = f"((g{cls}[{k + 1}] + {u.WEIGHT} * {p}) / (c{cls}[{k + 1}] + {u.WEIGHT}))"
        return p

    return rf"""
with r(rule, own, start, what) as (values {rules}),
u as (select page_id, row_number() over () as row, case when contains(url, '://') then regexp_replace(url, '^.*?://', '', 's') else '' end as rest from pages),
h as (select page_id, row, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select h.*, host || path as raw, f.rule, f.what from h left join (select row, arg_max(rule, length(rule)) as rule, arg_max(what, length(rule)) as what from h join r on (host = own or ends_with(host, '.' || own)) and starts_with(path, start) group by 1) f using (row)),
t as (select *, lower(raw) as txt, ('0x' || substr(md5(raw), 1, 7))::bigint % {u.FOLDS} = 0 as held from m),
c as (select row, txt, repeat(chr(1), {n - 1}) || txt as padded, unnest(range(1, length(txt) + 1)) as i from t),
e as ({each}),
l as (select k, gram, context, what = 'block' as bad from e join t using (row) where what is not null and not held),
g as (select k, gram, count(*) filter (not bad) as a, count(*) filter (bad) as b from l group by 1, 2),
x as (select k, context, count(*) filter (not bad) as a, count(*) filter (bad) as b from l group by 1, 2),
s as (select row, i, list(coalesce(g.a, 0) order by e.k) as ga, list(coalesce(g.b, 0) order by e.k) as gb, list(coalesce(x.a, 0) order by e.k) as ca, list(coalesce(x.b, 0) order by e.k) as cb from e left join g on g.k = e.k and g.gram = e.gram left join x on x.k = e.k and x.context = e.context group by 1, 2),
z as (select t.*, coalesce(score, 0) as score from t left join (select row, sum(ln({chance('a')}) - ln({chance('b')})) / count(*) as score from s group by 1) using (row)),
v as (select what = 'block' as bad, least(greatest(floor((score + {u.REACH}) * {u.BINS / (2 * u.REACH)}), 0), {u.BINS - 1}) as bin from z where what is not null and held),
o as (select cut, count(*) filter (not bad and bin < cut) / nullif(count(*) filter (not bad), 0)::double + 1 - count(*) filter (bad and bin < cut) / nullif(count(*) filter (bad), 0)::double as error from v, (select unnest(range(0, {u.BINS + 1})) as cut) group by 1),
w as (select list(cut order by cut) as cuts from o where error <= (select min(error) from o) + 1e-12),
y as (select case when len(cuts) > 0 then -{u.REACH} + cuts[len(cuts) // 2 + 1] * {2 * u.REACH / u.BINS} else 0 end as bar, (select count(distinct bad) from l) = 2 as two from w)
select page_id, host, path, rule, case when what is not null then what when two and raw <> '' and score < bar then 'block' else 'allow' end as verdict, case when what is null then round(score, 6) end as score from z, y
"""


def op7_sql() -> str:
    """Every piece of every item scored against every passage, and the verification on lists of words."""
    d = decontaminate
    words = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "list_distinct(list_transform(range(1, greatest(1, len({0}) - {1} + 1) + 1), lambda place: array_to_string({0}[place : place + {1} - 1], ' ')))"
    return rf"""
with d as (select doc_id, row_number() over () as row, {words.format('text')} as ws from documents),
i0 as (select item_id, row_number() over () as item, text, {words.format('text')} as iw from benchmark),
i1 as (select *, len(iw) as n, len({words.format(r"regexp_extract(text, '(?s)^(.*?)(?:[.?!]\s|\n|$)', 1)")}) as q from i0 where len(iw) > 0),
i as (select item_id, item, iw, n, case when q = 0 or q = n then (n + 1) // 2 else q end as q from i1),
pc as (select item, iw, n, (n + {d.PIECE - 1}) // {d.PIECE} as k, unnest(range(0, (n + {d.PIECE - 1}) // {d.PIECE})) as j from i),
pw as (select item, item * 100000 + j as piece, unnest(iw[n * j // k + 1 : n * (j + 1) // k]) as w, n * (j + 1) // k - n * j // k as size from pc),
tf as (select item, piece, w, size, count(*) as tf from pw group by all),
df as (select w, count(*) as df from tf group by 1),
tot as (select count(*) as n, avg(size) as mean from (select distinct piece, size from tf)),
x0 as (select item, piece, w, ln(1 + (tot.n - df + 0.5) / (df + 0.5)) * tf * ({d.K1} + 1) / (tf + {d.K1} * (1 - {d.B} + {d.B} * size / mean)) as x from tf join df using (w), tot),
x as (select item, piece, w, x / sum(x) over (partition by piece) as x from x0),
p as (select distinct row, s, (place - 1 + s) // {d.PASSAGE} as p, ws[place] as w from (select row, ws, unnest(range(1, len(ws) + 1)) as place from d), (select unnest([0, {d.PASSAGE // 2}]) as s)),
sc as (select row, s, p, item, piece, sum(x) as score from p join x using (w) group by all having sum(x) >= {d.THRESHOLD}),
be as (select row, item, p * {d.PASSAGE} - s as start, max(score) as score from sc group by all),
re as (select be.row, doc_id, item_id, i.item, score, greatest(0, start) as first, iw, n, q, ws[greatest(0, greatest(0, start) - n) + 1 : start + {d.PASSAGE} + n] as region from be join d using (row) join i using (item)),
g as (select *, list_distinct(iw[1 : q]) as qs, list_distinct(case when q < n then iw[q + 1 :] else iw[1 : q] end) as an, list_distinct(region) as there, {grams.format('iw', 'least(2, n)')} as ip, {grams.format('region', 'least(2, n)')} as rp,
 {grams.format('iw', f'least({d.SHINGLE}, n)')} as ish, {grams.format('region', f'least({d.SHINGLE}, n)')} as rsh from re),
v as (select *, len(list_intersect(ish, rsh)) / len(ish)::double as overlap from g where len(list_intersect(qs, there)) >= {d.PART_OVERLAP} * len(qs) and len(list_intersect(an, there)) >= {d.PART_OVERLAP} * len(an) and len(list_intersect(ip, rp)) >= {d.PAIR_OVERLAP} * len(ip)),
b as (select *, row_number() over (partition by row, item order by overlap desc, round(score, 9) desc, first) as best from v)
select doc_id, item_id, round(score, 9) as score, overlap, first::bigint as first_word from b where best = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": op1_sql(), "op2_suffix_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op5_chat_formatting": OP5_SQL, "op6_url_filter": op6_sql(), "op7_benchmark_decontamination": op7_sql(), "op9_quality_rules": op9_sql()}

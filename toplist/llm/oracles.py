"""SQL (DuckDB) for the registered queries that SQL can express, from the contract and not from the Spark code."""

from __future__ import annotations

from toplist.llm.mixing import FILL_ROUNDS
from toplist.llm.quality_rules import Limits

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEAR_DEDUP = rf"""
with recursive w as (
  select doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as ws from documents),
s as (
  select distinct doc_id, shingle from (
    select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [ws]
      else list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) end) as shingle from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c
  from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * c >= 80 * (na.n + nb.n - c)),
both_ways as (select a, b from links union select b, a from links),
reach as (
  select doc_id as a, doc_id as b from documents
  union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least as (select a, min(b) as m from reach group by a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m as component_id, d.doc_id = m as kept
from documents d join least on least.a = d.doc_id left join n on n.doc_id = d.doc_id"""


def _mixing() -> str:
    rounds, last = "", "placed"
    for i in range(FILL_ROUNDS):
        fits = "not extra and size > 0" + (" and size <= gap" if i else "")
        rounds += f""",
summed{i} as (
  select *, case when {fits} then size else 0 end as s,
    sum(case when {fits} then size else 0 end) over (
      partition by place order by key, doc_id rows between unbounded preceding and current row) as upto
  from {last}),
filled{i} as (
  select * exclude (s, upto, extra, gap), extra or (s > 0 and upto <= gap) as extra,
    gap - sum(case when s > 0 and upto <= gap then size else 0 end) over (partition by place) as gap
  from summed{i})"""
        last = f"filled{i}"
    return rf"""
with sized as (
  select doc_id, source, cast(len({_WORDS.format("coalesce(text, '')")}) as bigint) as size,
    -ln((cast('0x' || substr(md5('mix:' || doc_id), 1, 13) as bigint) + 0.5::double) / 4503599627370496::double)
      / case when length(text) > 0
          then 0.5::double + length(regexp_replace(text, '[^\p{{L}}]+', '', 'g'))::double / length(text)
          else 0.5::double end as key
  from documents),
sources as (
  select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as place
  from sized group by source),
weighed as (
  select *, [5, 2, 1][place % 3 + 1]::double as weight, 3::double * source_size as cap from sources),
levels as (
  select *, coalesce(sum(cap) over o, 0) as cap_before, coalesce(sum(weight) over o, 0) as weight_before
  from weighed window o as (order by cap / weight, place rows between unbounded preceding and 1 preceding)),
level as (
  select max(((select sum(source_size) from sources) - cap_before)
    / ((select sum(weight) from weighed) - weight_before)) as level from levels),
targets as (
  select source, place, source_size, least(cap, level * weight) as target from levels, level),
placed as (
  select doc_id, size, key, place, cast(t.source_size as bigint) as source_size, target,
    cast(case when t.source_size > 0 then least(3, floor(target / t.source_size)) else 0 end as bigint) as epochs,
    target - epochs * t.source_size as gap, false as extra
  from sized join targets t on sized.source is not distinct from t.source){rounds},
closing as (
  select place, arg_min(doc_id, (abs(size - gap), key)) as doc_id
  from {last} where not extra and size > 0 and abs(size - gap) < gap group by place)
select f.doc_id, f.size, source_size, target,
  cast((epochs + case when extra or c.doc_id is not null then 1 else 0 end) * f.size as bigint) as taken
from {last} f left join closing c on c.place = f.place and c.doc_id = f.doc_id"""


def _quality_rules(p: Limits = Limits()) -> str:
    count = lambda cls: f"length(text) - length(regexp_replace(text, '{cls}+', '', 'g'))"
    part = lambda x, y: f"case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0 end"
    distance = (
        "sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: "
        + part("z[1]", "z[2]") + " + " + part("z[2]", "z[1]") + ")) / 2, 0))"
    )
    return rf"""
with t as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as ws
  from documents),
base as (
  select doc_id, lang, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    {count("[#*$%&|<>]")} as n_symbols, length(text) as n_chars,
    {count(chr(92) + "p{Lu}")} as n_upper, {count(chr(92) + "p{Nd}")} as n_digit,
    {count("[.,;:?!''" + chr(34) + "()-]")} as n_mark
  from t),
lines as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from t)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
windows as (
  select doc_id, i, ws[i:i + 7] as win from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from t)),
repeated as (
  select doc_id, count(distinct place) as n_repeat_words from (
    select doc_id, unnest(range(i, i + 8)) as place from windows
    where (doc_id, win) in (select (doc_id, win) from windows group by doc_id, win having count(*) > 1))
  group by doc_id),
class_sums as (
  select lang, sum(n_chars) as c, sum(n_upper) as u, sum(n_digit) as d, sum(n_mark) as m,
    sum(n_chars - word_chars) as g, sum(n_symbols) as s, sum(n_words) as total from base group by lang),
used as (
  select lang, word, count(*) as uses from (select lang, unnest(ws) as word from t)
  where strlen(word) <= 6 group by lang, word),
top as (
  select lang, list(word order by r) as words, list(uses order by r) as uses from (
    select *, row_number() over (partition by lang order by uses desc, word) as r from used)
  where r <= {p.common_words} group by lang),
refs as (
  select class_sums.lang, words,
    case when c > 0 then [u / c, d / c, m / c, g / c, s / c, (c - (u + d + m + g + s)) / c] end as class_shares,
    list_append(list_transform(uses, lambda x: x / total), 1 - list_sum(uses) / total) as word_shares
  from class_sums left join top on top.lang = class_sums.lang),
hits as (
  select doc_id, t.lang, list_transform(words, lambda x: len(list_filter(ws, lambda y: y = x))) as counts
  from t join refs on refs.lang = t.lang),
shares as (
  select base.*, refs.class_shares, refs.word_shares, list_sum(counts) as n_common,
    case when n_chars > 0 then list_transform([n_upper, n_digit, n_mark, n_chars - word_chars, n_symbols,
      n_chars - (n_upper + n_digit + n_mark + n_chars - word_chars + n_symbols)], lambda x: x / n_chars) end as own_classes,
    case when n_words > 0 then list_append(list_transform(counts, lambda x: x / n_words),
      (n_words - list_sum(counts)) / n_words) end as own_words
  from base join refs on refs.lang = base.lang join hits on hits.doc_id = base.doc_id),
told as (
  select *, case when n_chars >= {p.min_chars_for_classes} then {distance.format(p="own_classes", q="class_shares")} end as cd,
    case when n_words >= {p.min_words_for_common} then {distance.format(p="own_words", q="word_shares")} end as wd,
    n_words >= {p.min_words_for_common}
      and 100 * n_common < {p.min_common_percent} * n_words * (1 - list_last(word_shares)) as few_common
  from shares),
judged as (
  select told.*, coalesce(n_dup_lines, 0) as dup, coalesce(n_repeat_words, 0) as rep,
    n_words < {p.min_words} or 100 * coalesce(n_repeat_words, 0) > {p.max_repeat_percent} * n_words as base_failed
  from told left join lines on lines.doc_id = told.doc_id left join repeated on repeated.doc_id = told.doc_id)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(dup as bigint) as n_dup_lines, cast(rep as bigint) as n_repeat_words,
  base_failed, not base_failed and coalesce(cd <= {p.max_class_distance}, true)
    and coalesce(wd <= {p.max_word_distance}, true) and coalesce(not few_common, true) as kept,
  round(cd, 6) as class_distance, round(wd, 6) as word_distance
from judged"""


REPEATS = """
with h as (select doc_id, hex(coalesce(text, '')) as x from documents),
windows as (
  select doc_id, i, md5(substr(x, 2 * i + 1, 400)) as digest
  from (select doc_id, x, unnest(range(0, cast(length(x) / 2 as bigint) - 199)) as i from h)),
hit as (
  select doc_id, i from windows
  where digest in (select digest from windows group by digest having count(*) > 1)),
runs as (
  select doc_id, min(i) as s, max(i) + 200 as e from (
    select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from (
      select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as fresh
      from hit))
  group by doc_id, run),
edges as (
  select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as before from runs),
kept as (
  select doc_id, count(*) as n, sum(e - s) as removed, max(e) as last,
    string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' order by s) as pieces
  from edges join h using (doc_id) group by doc_id)
select h.doc_id, cast(length(x) / 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed,
  cast(coalesce(n, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(pieces, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from h left join kept on kept.doc_id = h.doc_id"""

URL_FILTERS = f"""
with rules(r_host, r_path, r_verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
cut as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from rest),
parts as (
  select page_id, translate(raw, '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from cut),
best as (
  select page_id, r_host || r_path as rule, r_verdict,
    row_number() over (partition by page_id order by len(string_split(r_host, '.')) desc, length(r_path) desc) as k
  from parts join rules on (host = r_host or suffix(host, '.' || r_host)) and starts_with(path, r_path))
select parts.page_id, host, path, rule, coalesce(r_verdict, 'allow') as verdict
from parts left join best on best.page_id = parts.page_id and k = 1"""

EXACT_DEDUP = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as n_chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by bare) as group_size,
  first_value(doc_id) over w = doc_id as kept, sha256(bare) as text_sha256
from n window w as (partition by bare order by n_chars desc, doc_id)
"""

HARD_NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same,
    cast(list_inner_product(a.v, b.v) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (
  select * from (select a, b, score, row_number() over (partition by a order by score desc, b) as k from s where same)
  where k <= 5),
n as (
  select p.a, p.b, p.k, s.b as other, p.score as positive_score, s.score,
    row_number() over (partition by p.a, p.k order by s.score desc, s.b) as rank
  from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a as anchor_id, b as positive_id, cast(rank as integer) as rank, other as negative_id, positive_score,
  score as negative_score
from n where rank <= 3"""

ORACLES = {
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op4_source_mixing": _mixing(),
    "op7_quality_rules": _quality_rules(),
    "op8_suffix_array_dedup": REPEATS,
    "op9_url_filters": URL_FILTERS,
    "op12_exact_dedup": EXACT_DEDUP,
    "op13_hard_negatives": HARD_NEGATIVES,
}

"""SQL twins of the queries of this subpackage, for DuckDB."""

SQL: dict[str, str] = {}

#: A-Z lower-cased, nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(width: int, percent: int, source: str = "documents") -> str:
    """doc_id, n_shingles, component_id, kept."""
    joined = " || ' ' || ".join(f"w[i + {j}]" for j in range(width))
    return f"""
with recursive words as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from {source}
), grams as (
  select distinct doc_id, gram from (
    select doc_id, unnest(list_transform(range(1, len(w) - {width} + 2), lambda i: {joined})) as gram from words where len(w) >= {width}
    union all
    select doc_id, array_to_string(w, ' ') from words where len(w) between 1 and {width - 1})
), sized as (
  select doc_id, count(*) as n, sum(hash(gram)::hugeint % 1000000007) as h1, bit_xor(hash(gram, 1)) as h2 from grams group by doc_id
), classes as (
  select n, h1, h2, min(doc_id) as rep from sized group by n, h1, h2
), members as (
  select doc_id, rep, n from sized join classes using (n, h1, h2)
), links as (
  select a.doc_id as a, b.doc_id as b
  from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id
  join members ma on ma.doc_id = a.doc_id and ma.rep = a.doc_id
  join members mb on mb.doc_id = b.doc_id and mb.rep = b.doc_id
  group by a.doc_id, b.doc_id, ma.n, mb.n having 100 * count(*) >= {percent} * (ma.n + mb.n - count(*))
), steps as (
  select a, b from links union all select b, a from links union all select doc_id, rep from members where doc_id <> rep
  union all select rep, doc_id from members where doc_id <> rep
), reach as (
  select doc_id as origin, doc_id as place from words
  union select r.origin, s.b from reach r join steps s on s.a = r.place
), roots as (select origin as doc_id, min(place) as component_id from reach group by origin)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from words d join roots r on r.doc_id = d.doc_id left join sized s on s.doc_id = d.doc_id"""


SQL["op3_odd_sketch_near_duplicates"] = near_duplicates(4, 80)


def decontamination(source: str = "documents") -> str:
    words = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with items as (
  select distinct item_id, {words} as w from benchmark where item_id is not null
), windows as (
  select distinct item_id, array_to_string(list_slice(w, i, i + 9), ' ') as gram, least(10, len(w)) as size
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)
), docs as (
  select row_number() over () as k, doc_id, {words} as w from {source}
), sizes as (select distinct size from windows), places as (
  select k, w, size, unnest(range(1, len(w) - size + 2)) as i from docs cross join sizes where len(w) >= size
), found as (
  select p.k, p.i, p.size, x.item_id from places p join windows x on x.size = p.size and x.gram = array_to_string(list_slice(p.w, p.i, p.i + p.size - 1), ' ')
), hit as (
  select k, count(distinct j) as n_hit from (select k, unnest(range(i, i + size)) as j from found) group by k
), named as (
  select k, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct k, item_id::varchar as name from found) group by k
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(n.n_items, 0)::bigint as n_items,
  sha256(coalesce(n.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hit h on h.k = d.k left join named n on n.k = d.k"""


SQL["op5_prefix_filtered_decontamination"] = decontamination()


def line_dedup(min_words: int, source: str = "documents") -> str:
    """Runs as texts: from every line forwards and backwards, the shortest run of enough words."""
    return f"""
with lines as (
  select doc_id, i, line, len(regexp_extract_all(line, '[^\\x09-\\x0D\\x{{85}}\\p{{Z}}]+')) as words
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from {source})
  where words > 0
), sums as (
  select *, row_number() over (partition by doc_id order by i) as n, sum(words) over (partition by doc_id order by i) as total from lines
), docs as (
  select doc_id, list(line order by n) as l, list(total order by n) as c, list(i order by n) as p from sums group by doc_id
), ends as (
  select doc_id, l, c, p, unnest(range(1, len(l) + 1)) as x from docs
), runs as (
  select doc_id, l, p, x as a, list_position(list_transform(c, lambda t: t - coalesce(c[x - 1], 0) >= {min_words}), true) as b from ends
  union
  select doc_id, l, p, len(list_filter(c[:x], lambda t: c[x] - t >= {min_words})) + 1, x from ends where c[x] >= {min_words}
), keyed as (
  select doc_id, p, a, b, md5(array_to_string(l[a:b], chr(10))) as run from runs where b is not null and b >= a
), firsts as (
  select *, first_value(doc_id) over w as d1, first_value(a) over w as a1 from keyed window w as (partition by run order by doc_id, a)
), gone as (
  select distinct doc_id, unnest(p[a:b]) as i from firsts where (doc_id, a) <> (d1, a1)
), rest as (
  select l.doc_id, count(g.i) as n_deleted, string_agg(l.line, chr(10) order by l.i) filter (where g.i is null) as text
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from {source}) l
  left join gone g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(r.text, '') end as text, coalesce(r.n_deleted, 0)::bigint as n_deleted
from {source} d left join rest r on r.doc_id = d.doc_id"""


SQL["op10_suffix_array_line_dedup"] = line_dedup(50)


SQL["op2_term_at_a_time_top_k"] = """
with vectors as (
  select vec_id, min(list_transform(embedding, lambda x: floor(64 * x::double)::bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from vectors q join vectors c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20"""


def url_filter(rules: list[tuple[str, str]], order: int = 5, weight: float = 2.0, alphabet: int = 256) -> str:
    fits, told = "null", "null"
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, rest = rule.partition("/")
        fits = f"case when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash + rest}') then '{rule}' else {fits} end"
        told = f"case when rule = '{rule}' then '{verdict}' else {told} end"
    levels = [f"c{order} as (select gram, sum(good) as good, sum(bad) as bad from places group by gram)"]
    for k in range(order - 1, 0, -1):
        levels.append(f"c{k} as (select substr(gram, 2) as gram, sum(good) as good, sum(bad) as bad from c{k + 1} group by 1)")
    for k in range(1, order + 1):
        lower = f"l.p_good as q_good, l.p_bad as q_bad from c{k} c join l{k - 1} l on l.gram = substr(c.gram, 2)" if k > 1 else f"1.0::double / {alphabet} as q_good, 1.0::double / {alphabet} as q_bad from c{k} c"
        levels.append(f"""l{k} as (
  select gram, (good + {weight} * q_good) / (all_good + {weight}) as p_good, (bad + {weight} * q_bad) / (all_bad + {weight}) as p_bad from (
    select c.gram, c.good, c.bad, x.all_good, x.all_bad, {lower}
    join (select left(gram, {k - 1}) as context, sum(good) as all_good, sum(bad) as all_bad from c{k} group by 1) x on x.context = left(c.gram, {k - 1})))""")
    return f"""
with parts as (
  select page_id, coalesce(url, '') as url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), ruled as (select *, {fits} as rule from split), told as (select *, {told} as told from ruled
), urls as (
  select url, count(*) filter (where told = 'allow') as good, count(*) filter (where told = 'block') as bad from told group by url
), places as (
  select url, good, bad, substr(padded, i, {order}) as gram from (
    select url, good, bad, repeat(chr(2), {order - 1}) || url || chr(3) as padded, unnest(range(1, length(url) + 2)) as i from urls)
), {", ".join(levels)}, scored as (
  select p.url, sum(round((ln(p_good) - ln(p_bad)) * 1e6)::bigint)::bigint as total, count(*) as n from places p join l{order} l using (gram) group by p.url
), bins as (
  select greatest(-1000, least(1000, floor(total / (n * 10000))))::bigint as t, sum(good) as good, sum(bad) as bad
  from scored join urls using (url) where good > 0 or bad > 0 group by 1
), gains as (
  select t, round(coalesce(sum(bad) over w, 0) / greatest(sum(bad) over (), 1) - coalesce(sum(good) over w, 0) / greatest(sum(good) over (), 1), 9) as gain
  from bins window w as (order by t rows between unbounded preceding and 1 preceding)
  union all select 0, -2.0
), best as (select t from gains order by gain desc, abs(t), t limit 1)
select page_id, host, path, rule, coalesce(told, case when total >= t * 10000 * n then 'allow' else 'block' end) as verdict
from told join scored using (url) cross join best"""


SQL["op4_markov_url_filter"] = url_filter(
    [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
)


def filter_audit(source: str = "documents", labels: str = "labels", least_words: int = 200) -> str:
    """Each order and step counted from the documents' combinations of failed filters, given as strings of letters."""
    return f"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from {source}
), firsts as (select text, min(doc_id) as least from texts group by text
), counted as (
  select t.doc_id, t.part, t.text, f.least, regexp_extract_all(t.text, '[^\\x20\\x09-\\x0D]+') as w from texts t join firsts f on f.text = t.text
), failing as (
  select doc_id, part, case when len(w) < {least_words} then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when doc_id > least then 'E' else '' end as fails
  from counted
), marks as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from {labels} group by doc_id
), cells as (
  select part, fails, count(*) as n, coalesce(sum(m.good), 0) as good, coalesce(sum(m.toxic), 0) as toxic
  from failing f left join marks m on m.doc_id = f.doc_id group by part, fails
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a join letters b on b.x <> a.x join letters c on c.x not in (a.x, b.x)
  join letters d on d.x not in (a.x, b.x, c.x) join letters e on e.x not in (a.x, b.x, c.x, d.x)
), steps as (
  select filter_order, step, substr(filter_order, step, 1) as own, left(filter_order, step - 1) as earlier
  from orders cross join (select unnest([1, 2, 3, 4, 5]) as step)
), held as (
  select s.filter_order, s.step, s.own, c.part, c.n, c.good, c.toxic, c.fails,
    contains(c.fails, s.own) as failed, length(translate(c.fails, s.earlier, '')) < length(c.fails) as gone
  from steps s cross join cells c
), summed as (
  select part, filter_order, step, own, coalesce(sum(n) filter (where not failed and not gone), 0)::bigint as kept,
    coalesce(sum(n) filter (where failed and not gone), 0)::bigint as removed, coalesce(sum(n) filter (where failed and gone), 0)::bigint as redundant,
    coalesce(sum(n) filter (where fails = own), 0)::bigint as unique_fails, coalesce(sum(good) filter (where failed and not gone), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where failed and not gone), 0)::bigint as toxic_lost
  from held group by part, filter_order, step, own
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, own)::bigint as shapley from summed"""


SQL["op12_filter_audit"] = filter_audit()


def importance_resampling(source: str = "documents", target: str = "benchmark", buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    """Single words as features. The checksum (CRC-32, reflected polynomial 0xEDB88320) is taken byte by byte, once per word."""
    words = f"unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word"
    return f"""
with numbered as (select row_number() over () as k, doc_id, text from {source}
), own as (select k, word, count(*) as n from (select k, {words} from numbered) group by k, word
), aim as (select word, count(*) as n from (select {words} from {target}) group by word
), crc as (
  select list(c order by b) as t from (
    select b, list_reduce([b::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(b))
), hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::bigint)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} as bucket
  from (select word from own union select word from aim) cross join crc
), gains as (
  select b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (sum(coalesce(s.n, 0)) over () + {buckets}) / ((coalesce(s.n, 0) + 1)::double * (sum(coalesce(t.n, 0)) over () + {buckets}))))::bigint as gain
  from (select unnest(range({buckets})) as bucket) b
  left join (select bucket, sum(n) as n from own join hashed using (word) group by bucket) s on s.bucket = b.bucket
  left join (select bucket, sum(n) as n from aim join hashed using (word) group by bucket) t on t.bucket = b.bucket
), weights as (
  select k, sum(n) as n_features, sum(n * gain) as weight from own join hashed using (word) join gains using (bucket) group by k
), scored as (
  select k, d.doc_id, coalesce(w.n_features, 0)::bigint as n_features, coalesce(w.weight, 0)::bigint as weight,
    (coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{seed}:' || d.doc_id), 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from numbered d left join weights w using (k)
), placed as (
  select k, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= {least_words} and doc_id is not null
)
select doc_id, n_features, weight, score, case when place <= floor({percent} * n / 100) then place end::bigint as rank from scored left join placed using (k)"""


SQL["op13_importance_resampling"] = importance_resampling()

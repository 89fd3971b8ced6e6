"""DuckDB SQL for the text queries that SQL can express."""

#: Words, windows and hits by plain joins; an item shorter than a window is one window.
DECONTAMINATION = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), win as (
  select distinct item, least(13, len(w)) as size, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as g
  from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from item where len(w) > 0)
), sizes as (select distinct size from win), spot as (
  select doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as g
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from doc, sizes where len(w) >= size)
), occ as (select s.doc_id, s.i, s.size, win.item from spot s join win on s.g = win.g and s.size = win.size
), hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from occ)) group by 1
), its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from occ) group by 1)
select doc.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit on doc.doc_id = hit.doc_id left join its on doc.doc_id = its.doc_id
"""

#: Each url against each of the five rules; the longest fitting one wins.
URL_FILTERS = r"""
with rules(rhost, rpath, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), fit as (
  select p.page_id, p.host, p.path, max(struct_pack(size := length(rhost || rpath), rule := rhost || rpath, action := action)) as best
  from parts p left join rules r on (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath) group by all
)
select page_id, host, path, best.rule as rule, coalesce(best.action, 'allow') as verdict from fit
"""

#: All prefixes of all addresses with their totals; a row's shard is its shortest prefix that fits.
SHARDING = r"""
with rows as (
  select doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes, lpad(bin(cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 16) as ubigint)), 64, '0') as address from documents
), cut as (select *, substr(address, 1, depth) as shard from rows, (select unnest(range(0, 25)) as depth)
), sums as (select depth, shard, cast(sum(n_bytes) as bigint) as shard_bytes, count(*) as shard_rows from cut group by all
), fit as (select cut.doc_id, cut.n_bytes, cut.shard, cut.depth, shard_bytes, shard_rows,
    row_number() over (partition by cut.doc_id order by cut.depth) as k
  from cut join sums on cut.depth = sums.depth and cut.shard = sums.shard where shard_bytes <= 1048576 or shard_rows = 1)
select doc_id, n_bytes, shard, cast(depth as integer) as depth, cast(0 as bigint) as page, shard_bytes, shard_rows from fit where k = 1
"""

#: Word and pair counts of the whole corpus, and the logarithms of each document's positions.
LM_SCORING = r"""
with doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
pos as (select doc_id, i, w[i] as b, case when i > 1 then w[i - 1] end as a from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from doc)),
one as (select b as word, count(*) as c from pos group by 1), two as (select a, b, count(*) as c from pos where a is not null group by 1, 2), total as (select count(*) as n from pos),
scored as (
  select doc_id, case when pos.a is null then ln(w2.c / n) when two.c >= 2 then ln(two.c / w1.c) else ln(0.4 * w2.c / n) end as s
  from pos join one w2 on pos.b = w2.word left join one w1 on pos.a = w1.word left join two on pos.a = two.a and pos.b = two.b, total
), summed as (select doc_id, sum(s) as s from scored group by 1)
select doc.doc_id, cast(len(w) as bigint) as n_words, round(coalesce(s, 0.0), 4) as log_score, case when len(w) > 0 then round(s / len(w), 6) end as per_word
from doc left join summed on doc.doc_id = summed.doc_id
"""

#: All pairs of equal words at most a quarter of the text apart; crc32 bit by bit, as DuckDB has none.
PERIODIC_RUNS = r"""
with cut as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda b: list_concat([cast(ascii(b) as bigint)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
      lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c
  from documents
), planted as (
  select doc_id, w, len(w) as n, xor(c, 4294967295) as h, xor(c, 4294967295) // 10 as g from cut
), spec as (
  select doc_id, w, n, h % 10 = 0 and n > 0 as yes, case when n > 0 then g % n else 0 end as a, 3 + g % 8 as k from planted
), word as (
  select doc_id, n, i, w[1 + case when yes and i >= a then a + (i - a) % (1 + (n - a) // k) else i end] as word
  from (select *, unnest(range(0, n)) as i from spec where n > 0)
), same as (
  select x.doc_id, y.i - x.i as q, x.i from word x join word y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
), island as (
  select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from same
), stretch as (
  select doc_id, q, min(i) as s, count(*) + q as len from island group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)
), run as (
  select * from stretch x where not exists (select 1 from stretch y where y.doc_id = x.doc_id and y.q < x.q and y.s <= x.s and y.s + y.len >= x.s + x.len)
), listed as (
  select doc_id, count(*) as n_runs, min((-len, s, q)) as best, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as runs from run group by doc_id
), dropped as (
  select distinct doc_id, i from (select doc_id, unnest(range(s + q, s + len)) as i from run)
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as words from word x where not exists (select 1 from dropped d where d.doc_id = x.doc_id and d.i = x.i) group by doc_id
)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best[2] as start, -best[1] as length, best[3] as period, -1000 * best[1] // best[3] as exponent_milli,
  sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from documents d left join listed l on l.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""

#: Every posting of an item's term, weighted and summed, and the ten best of each item.
RANKED_SEARCH = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), sized as (select doc_id, w, len(w) as n from doc where len(w) > 0
), corpus as (select count(*) as docs, cast(coalesce(sum(n), 0) as bigint) as total from sized
), item as (
  select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from benchmark) group by all
), posting as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(w) as term from sized) where term in (select term from item) group by all
), weight as (select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from posting group by term), corpus
), scored as (
  select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) as bigint) as score
  from item join posting using (term) join weight using (term), corpus group by item_id, doc_id
), ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""

#: All pairs of documents with a shingle in common, the links among them, and what they reach.
JACCARD_JOIN = r"""
with recursive doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingle as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from doc where len(w) > 0)
), size as (select doc_id, count(*) as n from shingle group by 1
), pair as (select a.doc_id as x, b.doc_id as y, count(*) as shared from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), link as (select x, y from pair join size a on a.doc_id = x join size b on b.doc_id = y where 100 * shared >= 80 * (a.n + b.n - shared)
), edge as (select x, y from link union all select y, x from link
), reach(doc_id, r) as (select x, y from edge union select reach.doc_id, edge.y from reach join edge on reach.r = edge.x)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce((select min(r) from reach where reach.doc_id = d.doc_id), d.doc_id)) as component_id
from documents d left join size on size.doc_id = d.doc_id
"""

ORACLE_SQL = {"op7_lm_scoring": LM_SCORING, "op2_url_filters": URL_FILTERS, "op4_sharding": SHARDING, "op10_decontamination": DECONTAMINATION, "op11_jaccard_join": JACCARD_JOIN, "op12_periodic_runs": PERIODIC_RUNS, "op13_ranked_search": RANKED_SEARCH}

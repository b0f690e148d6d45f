"""SQL equivalents of the queries p1_, p2_ and p5_ that SQL can express."""

from __future__ import annotations

from strandlog.operators.profile import PLACEHOLDERS

_RECORDS = """
docs as (
  select file_id, max(doc) as doc from vector_docs where doc is not null and json_valid(doc) group by file_id
), held as (
  select file_id, 0 as place, 0::bigint as outer_pos, i as inner_pos, json_extract(doc, '$.samples[' || i || '].input') as record
  from docs, unnest(range(coalesce(json_array_length(doc, '$.samples'), 0)::bigint)) as t(i)
  union all
  select file_id, 1, 0, i, json_extract(doc, '$.input.entries[' || i || ']')
  from docs, unnest(range(coalesce(json_array_length(doc, '$.input.entries'), 0)::bigint)) as t(i)
  union all
  select file_id, 2, b, i, json_extract(doc, '$.input.batches[' || b || '].entries[' || i || ']')
  from (select file_id, doc, b from docs, unnest(range(coalesce(json_array_length(doc, '$.input.batches'), 0)::bigint)) as t(b)),
       unnest(range(coalesce(json_array_length(doc, '$.input.batches[' || b || '].entries'), 0)::bigint)) as u(i)
), records as (
  select file_id, row_number() over (partition by file_id order by place, outer_pos, inner_pos) - 1 as entry_pos,
         coalesce(json_extract_string(record, '$.metadata.accession'), '') as accession, record
  from held where json_exists(record, '$.metadata')
)"""

_GENES = """
{name} as (
  select file_id, entry_pos, accession, g as gene, json_extract(c, '$."' || g || '"') as v
  from (select *, json_extract(record, '$.{name}') as c from records) , unnest(json_keys(c)) as t(g) where json_type(c) = 'OBJECT'
  union all
  select file_id, entry_pos, accession, json_extract_string(c, '$[' || i || '].gene'), json_extract(c, '$[' || i || '].{key}')
  from (select *, json_extract(record, '$.{name}') as c from records), unnest(range(json_array_length(c)::bigint)) as t(i) where json_type(c) = 'ARRAY'
)"""

_SEQ = _GENES.format(name="alignedAminoAcidSequences", key="sequence")
_INS = _GENES.format(name="aminoAcidInsertions", key="insertions")
_INS_ROWS = "select *, i as item_pos, json_extract_string(v, '$[' || i || ']') as insertion from aminoAcidInsertions, unnest(range(json_array_length(v)::bigint)) as t(i) where json_type(v) = 'ARRAY'"

P1_FOUND = f"""with {_RECORDS}, {_SEQ}, {_INS}
select file_id, entry_pos, accession, 'alignedAminoAcidSequences' as child, gene, 0::bigint as item_pos
from alignedAminoAcidSequences where v is not null and json_type(v) != 'NULL' and gene is not null
union all
select file_id, entry_pos, accession, 'aminoAcidInsertions', gene, item_pos from ({_INS_ROWS}) where insertion is not null and gene is not null"""

P1_RECORDS = f"""with {_RECORDS}
select file_id, entry_pos, accession, try_cast(json_extract_string(record, '$.metadata.version') as bigint) as version, json_extract_string(record, '$.organism') as organism from records"""

P1_SEQUENCES = f"""with {_RECORDS}, {_SEQ}
select file_id, entry_pos, accession, gene, json_extract_string(v, '$') as sequence from alignedAminoAcidSequences where json_extract_string(v, '$') is not null and gene is not null"""

P1_INSERTIONS = f"""with {_RECORDS}, {_INS}
select file_id, entry_pos, accession, gene, item_pos, insertion from ({_INS_ROWS}) where insertion is not null and gene is not null"""

_TEXTS = ", ".join("'" + p.replace("'", "''") + "'" for p in PLACEHOLDERS)

_AROUND = """'^[\\s\\[(<{"'']+|[\\s\\])>}"'']+$'"""

_CELLS = f"""
cells as (
  select mirror, load_no, load_id, row_id, 'geoloccountry' as column_name, geoloccountry as value from zika_metadata
  union all select mirror, load_no, load_id, row_id, 'breadthofcoverage', breadthofcoverage from zika_metadata
  union all select mirror, load_no, load_id, row_id, 'ampliconsize', ampliconsize from zika_metadata
), classes as (
  select *, case
    when value is null then 'null'
    when regexp_full_match(value, '[\\s\\pZ\\-‐-―_.?*/\\\\#~]*') or lower(trim(value)) in ({_TEXTS}) or regexp_replace(regexp_replace(lower(value), {_AROUND}, '', 'g'), '[\\s_]+', ' ', 'g') in ({_TEXTS}) then 'placeholder'
    when column_name = 'geoloccountry' then case when value in (select name from geo_countries) then 'good' else 'pattern' end
    when column_name = 'breadthofcoverage' and not regexp_full_match(value, '-?[0-9]+(\\.[0-9]+)?') then 'pattern'
    when column_name = 'ampliconsize' and not regexp_full_match(value, '-?[0-9]+') then 'pattern'
    when column_name = 'breadthofcoverage' then case when value::double between 0 and 100 then 'good' else 'range' end
    else case when value::double between 50 and 15000 then 'good' else 'range' end end as class
  from cells
), good as (
  select *, case when column_name != 'geoloccountry' then value::double end as num from classes where class = 'good'
), loads as (
  select mirror, load_no, load_id, column_name, count(*) as n_rows, count(*) filter (where class = 'null')::bigint as n_null, count(*) filter (where class = 'placeholder')::bigint as n_placeholder,
    count(*) filter (where class = 'pattern')::bigint as n_pattern, count(*) filter (where class = 'range')::bigint as n_range, count(*) filter (where class = 'good')::bigint as n_good
  from classes group by all
), stats as (
  select load_id, column_name, case when column_name = 'geoloccountry' then count(distinct value) else count(distinct num) end as n_distinct,
    min(num) as low, max(num) as high, median(num) as median from good group by load_id, column_name
), pairs as (
  select l.*, coalesce(s.n_distinct, 0) as n_distinct, s.low, s.high, s.median, p.load_id as prev_id, p.n_rows as n_rows_prev, p.n_null + p.n_placeholder as n_missing_prev,
    p.n_good as n_good_prev, q.n_distinct as n_distinct_prev, q.median as median_prev
  from loads l left join stats s using (load_id, column_name)
  left join loads p on p.mirror = l.mirror and p.load_no = l.load_no - 1 and p.column_name = l.column_name
  left join stats q on q.load_id = p.load_id and q.column_name = p.column_name
), counts as (
  select load_id, column_name, value, num, count(*) as n from good group by all
), both_values as (
  select load_id, column_name, value, num, sum(n) as n, sum(m) as m from (
    select load_id, column_name, value, num, n, 0 as m from counts
    union all select p.load_id, p.column_name, c.value, c.num, 0, c.n from pairs p join counts c on c.load_id = p.prev_id and c.column_name = p.column_name
  ) group by load_id, column_name, value, num
)"""

P2_FOUND = f"""with {_CELLS}
select load_id, column_name, class as finding, row_id from classes where class in ('placeholder', 'pattern', 'range')
union all
select load_id, column_name, 'missing', 0 from pairs where prev_id is not null and abs((n_null + n_placeholder) * n_rows_prev - n_missing_prev * n_rows) * 5 >= n_rows * n_rows_prev
union all
select load_id, column_name, 'shift', 0 from pairs where n_good > 0 and n_good_prev > 0 and (
  (median != median_prev and (abs(median) >= 1.5 * abs(median_prev) or abs(median_prev) >= 1.5 * abs(median)))
  or (column_name = 'geoloccountry' and (select max(abs(b.n * n_good_prev - b.m * n_good)) from both_values b where b.load_id = pairs.load_id and b.column_name = pairs.column_name) * 4 >= n_good * n_good_prev))
union all
select load_id, column_name, 'distinct', 0 from pairs where n_good > 0 and n_good_prev > 0 and n_distinct != n_distinct_prev and (n_distinct >= 4 * n_distinct_prev or n_distinct_prev >= 4 * n_distinct)"""

P2_PROFILE = f"""with {_CELLS}, curves as (
  select b.load_id, b.column_name,
    sum(b.n) over w / p.n_good as f, sum(b.m) over w / p.n_good_prev as g, p.n_good, p.n_good_prev
  from both_values b join pairs p on p.load_id = b.load_id and p.column_name = b.column_name
  where p.n_good > 0 and p.n_good_prev > 0
  window w as (partition by b.load_id, b.column_name order by b.num, b.value range unbounded preceding)
), ks as (select load_id, column_name, max(abs(f - g)) as ks from curves group by all)
select mirror, load_no, load_id, column_name, n_rows, n_null, n_placeholder, n_pattern, n_range, n_good, n_distinct, low, high, round(median, 6) as median, round(ks, 9) as ks
from pairs left join ks using (load_id, column_name)"""

_DRIFT = """
with recursive parsed as (
  select line_id, mirror, organism, file_no, line->'$.metadata' as m from feed_lines
  where case when json_valid(line) then json_type(line, '$.metadata') = 'OBJECT' else false end and mirror is not null and organism is not null and file_no is not null),
kv as (
  select line_id, mirror, organism, file_no, accession, e.key as field, e.value as v, case coalesce(json_type(e.value), 'NULL') when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then null else 'number' end as t
  from (select line_id, mirror, organism, file_no, m->>'$.accession' as accession, unnest(map_entries(cast(m as map(varchar, json)))) as e from parsed)),
schemas as (select mirror, organism, file_no, field, coalesce(array_to_string(list_sort(list(distinct t) filter (where t is not null)), ','), '') as types from kv group by all),
files as (select distinct mirror, organism, file_no from schemas),
gone as (select s.mirror, s.organism, s.file_no + 1 as file_no, s.field from schemas s join files f on f.mirror = s.mirror and f.organism = s.organism and f.file_no = s.file_no + 1
  where not exists (select 1 from schemas n where n.mirror = s.mirror and n.organism = s.organism and n.file_no = s.file_no + 1 and n.field = s.field)),
came as (select s.mirror, s.organism, s.file_no, s.field from schemas s join files f on f.mirror = s.mirror and f.organism = s.organism and f.file_no = s.file_no - 1
  where not exists (select 1 from schemas n where n.mirror = s.mirror and n.organism = s.organism and n.file_no = s.file_no - 1 and n.field = s.field)),
vals as (select mirror, organism, file_no, accession, field, max(case when t is null then null when t = 'string' then v->>'$' else cast(v as varchar) end) as v from kv where accession is not null group by all),
gv as (select g.mirror, g.organism, g.file_no, g.field, v.accession, v.v from gone g join vals v on v.mirror = g.mirror and v.organism = g.organism and v.file_no = g.file_no - 1 and v.field = g.field),
cv as (select c.mirror, c.organism, c.file_no, c.field, v.accession, v.v from came c join vals v on v.mirror = c.mirror and v.organism = c.organism and v.file_no = c.file_no and v.field = c.field),
renamed as (select gv.mirror, gv.organism, gv.file_no, gv.field as was, cv.field as field from gv join cv on gv.mirror = cv.mirror and gv.organism = cv.organism and gv.file_no = cv.file_no and gv.accession = cv.accession
  group by all having count(*) filter (where gv.v = cv.v) >= 0.9 * count(*) filter (where gv.v is not null or cv.v is not null) and count(*) filter (where gv.v is not null or cv.v is not null) > 0),
names as (select s.mirror, s.organism, s.file_no, s.field, s.types, coalesce(r.was, p.field) as was from schemas s
  left join renamed r on r.mirror = s.mirror and r.organism = s.organism and r.file_no = s.file_no and r.field = s.field
  left join schemas p on p.mirror = s.mirror and p.organism = s.organism and p.file_no = s.file_no - 1 and p.field = s.field),
walk as (
  select mirror, organism, file_no, field, was, types, types as last, null::varchar as earlier, field as origin from names where was is null
  union all
  select n.mirror, n.organism, n.file_no, n.field, n.was, n.types, case when n.types = '' then w.last else n.types end, w.last, w.origin
  from walk w join names n on n.mirror = w.mirror and n.organism = w.organism and n.file_no = w.file_no + 1 and n.was = w.field)"""

P5_FOUND = _DRIFT + """
select mirror, organism, file_no::bigint as file_no, was as field, 'renamed' as change, field as new_field from renamed
union all select mirror, organism, file_no::bigint, field, 'removed', field from gone g where not exists (select 1 from renamed r where r.mirror = g.mirror and r.organism = g.organism and r.file_no = g.file_no and r.was = g.field)
union all select mirror, organism, file_no::bigint, field, 'added', field from came c where not exists (select 1 from renamed r where r.mirror = c.mirror and r.organism = c.organism and r.file_no = c.file_no and r.field = c.field)
union all select mirror, organism, file_no::bigint, was, 'type_changed', field from walk where types <> '' and earlier <> '' and types <> earlier"""

P5_UNITED = _DRIFT + r"""
select kv.mirror, kv.organism, kv.file_no, kv.line_id, kv.accession, w.origin as field, case t when 'string' then v->>'$' else regexp_replace(case t
  when 'object' then '{' || (select string_agg(to_json(e.key)::varchar || ':' || e.value::varchar, ',' order by e.key) from (select unnest(map_entries(try_cast(v as map(varchar, json)))) as e)) || '}'
  else v::varchar end, '([0-9])[.]0+([,}\]]|$)', '\1\2', 'g') end as value
from kv join walk w on w.mirror = kv.mirror and w.organism = kv.organism and w.file_no = kv.file_no and w.field = kv.field where t is not null"""

ORACLE = {
    "p1_found": P1_FOUND, "p1_records": P1_RECORDS, "p1_sequences": P1_SEQUENCES, "p1_insertions": P1_INSERTIONS,
    "p2_found": P2_FOUND, "p2_profile": P2_PROFILE, "p5_found": P5_FOUND, "p5_united": P5_UNITED,
}

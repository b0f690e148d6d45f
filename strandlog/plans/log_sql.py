"""SQL equivalents of the queries over the versioned log."""

from __future__ import annotations

from strandlog.plans.log_queries import AS_OF, CUTOFF, GENESIS, INDEX_BYTES

_FEED = f"""
released as (
  select 'zika' as organism, accession, version, groupid, datauseterms as terms, submittedattimestamp as submitted_at from (
    select *, row_number() over (partition by accession, version order by received_at desc, row_id desc) as n from zika_metadata) where n = 1
), eligible as (
  select organism, accession, version from released where terms = 'OPEN' and submitted_at <= {CUTOFF}
  union all select 'andv', accession, version from (
    select *, row_number() over (partition by accession, version order by received_at desc, row_id desc) as n from andv_metadata) where n = 1 and submittedattimestamp <= {CUTOFF}
), published as (select distinct organism, accession, version from entries)"""

_EVENTS = """
named as (select batch, organism, kind, note, unnest(accessionversions) as av from tombstones),
all_events as (
  select batch, organism, regexp_extract(av, '^(.*)[.]([^.]*)$', 1) as accession, cast(regexp_extract(av, '[.]([0-9]+)$', 1) as bigint) as version, kind, note
  from named where regexp_matches(av, '[.][0-9]+$')
), clash as (
  select distinct batch from (select batch, organism, accession, version from all_events group by all having count(distinct kind) > 1)
), events_ok as (select * from all_events where batch not in (select batch from clash)),
states as (
  select organism, accession, version, kind, batch from (
    select *, row_number() over (partition by organism, accession, version order by batch desc, kind) as n from events_ok) where n = 1
), withdrawn as (select organism, accession, version from states where kind = 'WITHDRAW'),
firsts as (select * from (select *, row_number() over (partition by organism, accession, version order by batch, ordinal) as n from entries) where n = 1)"""

_PAIRS = "array_to_string(list_sort(list_transform(map_entries({}), lambda e: e.key || '=' || coalesce({}, '\\N'))), ',')"
_TEXTS = [_PAIRS.format(c, "e.value") for c in ("alignedaminoacidsequences", "alignednucleotidesequences", "metadata", "unalignednucleotidesequences")]
_LISTS = [_PAIRS.format(c, "array_to_string(e.value, ';')") for c in ("aminoacidinsertions", "nucleotideinsertions")]
_PAYLOAD = f"concat_ws(chr(9), organism, accession, version::varchar, {', '.join(_TEXTS + _LISTS)})"

_AFTER = """
steps as (
  select organism, batch, accession, version, max(kind) as kind from events_ok group by all
), lagged as (
  select *, coalesce(lag(kind) over (partition by organism, accession, version order by batch), 'REINSTATE') as before from steps
), per_batch as (
  select organism, batch, count(*) filter (where kind = 'WITHDRAW') as named,
    sum(case when kind = 'WITHDRAW' and before != 'WITHDRAW' then 1 when kind != 'WITHDRAW' and before = 'WITHDRAW' then -1 else 0 end) as d
  from lagged group by organism, batch
), after_batches as (
  select organism, batch, named::bigint as withdrawn_in_batch, (sum(d) over (partition by organism order by batch))::bigint as withdrawn_total from per_batch
)"""

_MANIFESTS = f"""
manifests as (
  select *, ceil(raw_bytes / 1000)::bigint as n_blobs from (
    select batch, sha256(string_agg(organism || '.' || accession || '.' || version || chr(10), '' order by organism || '.' || accession || '.' || version)) as digest, sum(strlen({_PAYLOAD}))::bigint as raw_bytes
    from entries group by batch)
), linked as (
  select *, coalesce(lag(digest) over (order by batch), repeat('0', 64)) as previous_digest, (sum(n_blobs) over (order by batch))::bigint as blob_count_after from manifests
)"""

_COUNTS = """
added as (select batch, organism, count(*) as k from firsts group by all),
all_batches as (select distinct batch from (select batch from added union all select batch from after_batches)),
since as (select organism, min(batch) as since from (select organism, batch from added union all select organism, batch from after_batches) group by organism),
counts as (
  select b.batch, s.organism, coalesce(a.k, 0)::bigint as entries_in_batch,
    (sum(coalesce(a.k, 0)) over (partition by s.organism order by b.batch))::bigint as published_total,
    coalesce(w.withdrawn_in_batch, 0)::bigint as withdrawn_in_batch,
    coalesce(last_value(w.withdrawn_total ignore nulls) over (partition by s.organism order by b.batch rows unbounded preceding), 0)::bigint as withdrawn_total
  from all_batches b join since s on b.batch >= s.since
  left join added a on a.batch = b.batch and a.organism = s.organism
  left join after_batches w on w.batch = b.batch and w.organism = s.organism
)"""

_AUDIT = """
refs as (select o_orderkey as seq, o_custkey as block, epoch(o_orderdate)::bigint as block_time, sha256(o_orderkey::varchar) as hash from orders),
found as (select l_returnflag as source, l_orderkey as seq, case when l_linestatus = 'O' then 'verified' when l_tax >= 0.06 then 'corrupt' else 'error' end as outcome from lineitem),
sources as (select distinct source from found),
matrix as (
  select s.source, r.seq, coalesce(f.outcome, 'missing') as outcome from sources s cross join refs r left join (
    select source, seq, case when bool_or(outcome = 'verified') then 'verified' when bool_or(outcome = 'corrupt') then 'corrupt' else 'error' end as outcome from found group by source, seq
  ) f on f.source = s.source and f.seq = r.seq
), torn as (
  select o_orderkey as first_blob, o_orderkey + o_custkey % 3 as last_blob from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P'
), last_complete as (select coalesce(max(o_orderkey), 0) as m from orders where o_orderstatus = 'O'),
dead as (select distinct seq from (select unnest(range(first_blob, last_blob + 1)) as seq from torn where last_blob < (select m from last_complete)) where seq != 0),
lost as (select seq from refs where seq not in (select seq from matrix where outcome = 'verified'))"""


def _with(parts: str, body: str) -> str:
    return f"with {parts} {body}"


_KEY = "organism, accession, version"
_LINE = """(select *, json_extract_string(line, '$.metadata.accession') as accession, try_cast(json_extract_string(line, '$.metadata.version') as bigint) as version,
  json_extract_string(line, '$.metadata.dataUseTerms') as terms, try_cast(json_extract_string(line, '$.metadata.submittedAtTimestamp') as bigint) as submitted_at,
  case when not coalesce(list_sort(json_keys(line)) = ['alignedAminoAcidSequences', 'alignedNucleotideSequences', 'aminoAcidInsertions', 'metadata', 'nucleotideInsertions', 'unalignedNucleotideSequences'], false) then 'keys'
    when not coalesce(json_exists(line, '$.metadata.accession') and json_exists(line, '$.metadata.version') and json_exists(line, '$.metadata.accessionVersion') and json_exists(line, '$.metadata.dataUseTerms'), false) then 'metadata'
    when not coalesce(json_type(line, '$.metadata.version') in ('UBIGINT', 'BIGINT') and json_extract_string(line, '$.metadata.accession') || '.' || json_extract_string(line, '$.metadata.version') = json_extract_string(line, '$.metadata.accessionVersion'), false) then 'identity'
    else 'right' end as shape from feed_lines)"""

_HALF = "floor(({x}) + 0.5)::bigint"


def _h(x: str) -> str:
    return _HALF.format(x=x)


def _size(n: str) -> str:
    kb, mb, tenth = _h(f"({n}) / 1e3"), _h(f"({n}) / 1e6"), _h(f"({n}) / 1e8")
    return f"""case when ({n}) = 1 then '1 byte' when ({n}) < 1000 then ({n})::varchar || ' bytes' when {kb} < 1000 then {kb} || ' kB' when {mb} < 1000 then {mb} || ' MB'
      else ({tenth} // 10) || '.' || ({tenth} % 10) || ' GB' end"""


_SEC = f"greatest({_h('value * 97 - 40')}, 0)"
_MIN = _h(f"{_SEC} / 60")
_AGE = "value * 97"

ORACLE = {
    "eligible_new": _with(_FEED, f"select {_KEY} from (select distinct * from eligible) anti join published using ({_KEY})"),
    "sync_stats": _with(
        _FEED,
        f"""select groupid, count(*) as total, count(*) filter (where terms is not distinct from 'OPEN')::bigint as open, count(*) filter (where terms is distinct from 'OPEN')::bigint as restricted,
        count(*) filter (where terms = 'OPEN' and submitted_at > {CUTOFF})::bigint as held_back, count(*) filter (where terms = 'OPEN' and submitted_at <= {CUTOFF} and p.version is not null)::bigint as already_published,
        count(*) filter (where terms = 'OPEN' and submitted_at <= {CUTOFF} and p.version is null)::bigint as new
        from released r left join published p using ({_KEY}) group by groupid""",
    ),
    "already_published": _with(_FEED, f"select {_KEY} from (select distinct * from eligible) semi join published using ({_KEY})"),
    "withdraw_set": _with(f"{_FEED}, {_EVENTS}", f"select {_KEY} from published anti join withdrawn using ({_KEY}) anti join eligible using ({_KEY})"),
    "reinstate_set": _with(f"{_FEED}, {_EVENTS}", f"select {_KEY} from withdrawn semi join eligible using ({_KEY})"),
    "change_lists": _with(
        f"{_FEED}, {_EVENTS}",
        f"select organism, string_agg(av, ',' order by av) as accession_versions from (select distinct organism, accession || '.' || version as av from withdrawn semi join eligible using ({_KEY})) group by organism",
    ),
    "unserved_group": "select distinct organism from entries anti join feed_lines using (organism)",
    "visible_after_changes": _with(
        f"{_FEED}, {_EVENTS}",
        f"select distinct {_KEY} from eligible",
    ),
    "feed_scan": f"select line_id, file_id, accession, version, terms, submitted_at from {_LINE} where shape = 'right' and line != ''",
    "feed_shape": f"select mirror, shape, count(*) as n from {_LINE} group by all",
    "line_keys": "select organism, array_to_string(list_sort(json_keys(line)), ',') as keys, count(*) as n from feed_lines group by all",
    "feed_incomplete": "select file_id, total, n_lines from (select f.file_id, f.total, count(l.line_id) as n_lines from feed_files f left join feed_lines l on l.file_id = f.file_id where total is not null group by all) where total != n_lines",
    "feed_changed": """select file_id, mirror, organism, file_no::bigint as file_no from (select *, lag(etag) over (partition by mirror, organism order by file_no) as before from feed_files)
      where etag is null or before is null or etag != before""",
    "feed_groups": "select organism, count(distinct mirror) as mirrors, count(*) as files from feed_files group by organism",
    "published_projection": f"""select batch, ordinal, {_KEY}, array_to_string(list_sort(list_filter(map_keys(metadata), lambda k: k not in ('versionStatus', 'dataUseTerms', 'dataUseTermsRestrictedUntil', 'dataUseTermsUrl'))), ',') as fields from entries""",
    "entry_validation": """select organism, case when organism is null or organism = '' then 'organism' when accession is null or accession = '' then 'accession' when version is null or version < 1 then 'version'
      when accession || '.' || version is distinct from metadata['accessionVersion'] then 'identity' else 'right' end as problem, count(*) as n from entries group by all""",
    "keep_first": _with(_EVENTS, f"select batch, ordinal, {_KEY} from firsts"),
    "duplicate_entries": f"select batch, ordinal, {_KEY} from (select *, row_number() over (partition by {_KEY} order by batch, ordinal) as n from entries) where n > 1",
    "tombstone_state": _with(_EVENTS, f"select {_KEY}, kind, batch from states"),
    "tombstone_as_of": _with(
        _EVENTS, f"select {_KEY}, kind, batch from (select *, row_number() over (partition by {_KEY} order by batch desc, kind) as n from events_ok where batch <= {AS_OF}) where n = 1"
    ),
    "tombstone_conflicts": _with(_EVENTS, f"select batch, {_KEY} from all_events where kind = 'WITHDRAW' intersect select batch, {_KEY} from all_events where kind = 'REINSTATE'"),
    "withdrawn_after_batches": _with(f"{_EVENTS}, {_AFTER}", "select organism, batch, withdrawn_in_batch, withdrawn_total from after_batches"),
    "ineffective_events": _with(
        _EVENTS, f"select batch, {_KEY}, kind from (select *, coalesce(lag(kind) over (partition by {_KEY} order by batch), 'REINSTATE') as before from events_ok) where kind = before"
    ),
    "visible_rows": _with(_EVENTS, f"select batch, ordinal, {_KEY} from firsts anti join withdrawn using ({_KEY})"),
    "visible_as_of": _with(
        _EVENTS,
        f"""select batch, ordinal, {_KEY} from (select * from firsts where batch <= {AS_OF}) anti join (
          select {_KEY} from (select *, row_number() over (partition by {_KEY} order by batch desc, kind) as n from events_ok where batch <= {AS_OF}) where n = 1 and kind = 'WITHDRAW') using ({_KEY})""",
    ),
    "visible_counts": _with(
        _EVENTS,
        f"""select o.organism, count(distinct p.av) as published, count(distinct case when w.av is null then p.av end) as entries_total, (select count(*) from withdrawn x where x.organism = o.organism) as withdrawn_total
        from (select organism from entries union select organism from events_ok) o
        left join (select distinct organism, accession || '.' || version as av from entries) p on p.organism = o.organism
        left join (select organism, accession || '.' || version as av from withdrawn) w on w.organism = p.organism and w.av = p.av group by o.organism""",
    ),
    "version_status": _with(
        _EVENTS,
        f"""select {_KEY}, case when version < max(version) over (partition by organism, accession) then 'REVISED' when coalesce(metadata['isRevocation'] = 'true', false) then 'REVOKED_LATEST' else 'LATEST' end as status from firsts""",
    ),
    "published_map": f"select organism, accession, string_agg(version || ':' || b, ',' order by version) as versions from (select {_KEY}, min(batch) as b from entries group by all) group by organism, accession",
    "withdrawn_map": _with(_EVENTS, "select organism, accession, string_agg(version::varchar, ',' order by version) as versions from withdrawn group by organism, accession"),
    "canonical_order": _with(
        _EVENTS,
        """select 0 as section, organism, '' as name, 0::bigint as version from (select distinct organism from entries) union all select 1, '', 'README.md', 0
        union all select distinct 2, organism, '', 0 from events_ok where kind = 'WITHDRAW' union all select distinct 3, organism, '', 0 from events_ok where kind = 'REINSTATE'
        union all select 4, organism, accession, version from firsts""",
    ),
    "set_union": _with(_EVENTS, "select organism from entries union select organism from events_ok"),
    "set_intersect": _with(_EVENTS, f"select {_KEY} from entries intersect select {_KEY} from events_ok"),
    "set_except": _with(_EVENTS, f"select distinct {_KEY} from (select {_KEY} from entries except all select {_KEY} from events_ok)"),
    "artifact_digest": _with(
        _EVENTS,
        f"""select o.organism, coalesce(d.n_lines, 0) as n_lines, coalesce(d.h, sha256('')) as sha256 from (select organism from entries union select organism from events_ok) o left join (
          select organism, count(*) as n_lines, sha256(string_agg(line, chr(10) order by accession, version) || chr(10)) as h from (select {_KEY}, {_PAYLOAD} as line from firsts anti join withdrawn using ({_KEY})) group by organism) d using (organism)""",
    ),
    "batch_digest": _with(
        _EVENTS, f"select batch, count(*) as n_lines, sha256(string_agg(line, chr(10) order by {_KEY}) || chr(10)) as sha256 from (select batch, {_KEY}, {_PAYLOAD} as line from firsts) group by batch"
    ),
    "hash_chain": """select batch, count(*) as n, list_reduce(list_prepend(repeat('0', 64), list(sha256(accession || '.' || version) order by ordinal)), lambda a, x: sha256(a || x)) as head from entries group by batch""",
    "chain_contiguity": "select count(*) as n, count(*) = 0 or (min(event_id) = 0 and max(event_id) = count(*) - 1 and count(distinct event_id) = count(*)) as contiguous from events",
    "manifest_counts": _with(f"{_EVENTS}, {_AFTER}, {_COUNTS}", "select * from counts"),
    "manifest_compare": _with(
        _EVENTS,
        """select coalesce(s.organism, c.organism) as organism, case when c.organism is null then 'only_stated' when s.organism is null then 'only_computed' when s.published is not distinct from c.published then 'match' else 'differs' end as status
        from (select organism, count(*) as published from entries where organism != 'mpox' group by organism) s full join (
          select o.organism, count(f.accession) as published from (select organism from entries union select organism from events_ok) o left join firsts f on f.organism = o.organism group by o.organism) c on c.organism = s.organism""",
    ),
    "manifest_chain": _with(_MANIFESTS, "select batch, digest, raw_bytes, n_blobs, previous_digest, blob_count_after - n_blobs as first_blob, blob_count_after from linked"),
    "manifest_breaks": _with(
        _MANIFESTS,
        """select batch, problem from (select batch, case when lag(batch) over w is null and batch != 0 then 'first' when batch != coalesce(lag(batch) over w + 1, 0) then 'number'
        when case when batch % 7 = 6 then sha256(previous_digest) else previous_digest end != coalesce(lag(digest) over w, repeat('0', 64)) then 'digest'
        when blob_count_after - n_blobs < coalesce(lag(blob_count_after) over w, 0) then 'blobs' end as problem from linked window w as (order by batch)) where problem is not null""",
    ),
    "index_placement": _with(
        _MANIFESTS,
        f""", numbered as (select batch, raw_bytes as size, row_number() over (order by batch) as k from manifests)
        select batch, size, since_index, since_index >= {INDEX_BYTES} as has_index from (
          with recursive walk as (
            select k, batch, size, size as since_index from numbered where k = 1
            union all select n.k, n.batch, n.size, n.size + case when w.since_index >= {INDEX_BYTES} then 0 else w.since_index end from walk w join numbered n on n.k = w.k + 1)
          select * from walk)""".lstrip(),
    ),
    "schema_drift": """with recursive shapes as (
        select organism, batch, ordinal, concat_ws('|', coalesce(array_to_string(list_sort(map_keys(metadata)), ','), ''), coalesce(array_to_string(list_sort(map_keys(unalignednucleotidesequences)), ','), ''), coalesce(array_to_string(list_sort(map_keys(alignedaminoacidsequences)), ','), '')) as shape from entries
      ), lasts as (select organism, batch, shape, max(ordinal) as ordinal, dense_rank() over (partition by organism order by batch) as k from shapes group by organism, batch, shape
      ), walk as (
        select organism, 0::bigint as k, null::bigint as batch, null::varchar as published, null::varchar as emitted from (select distinct organism from lasts)
        union all
        select w.organism, n.k, n.batch, coalesce(n.shape, w.published), n.shape from walk w join lateral (
          select w.k + 1 as k, (select max(batch) from lasts l where l.organism = w.organism and l.k = w.k + 1) as batch,
            (select arg_max(l.shape, l.ordinal) from lasts l where l.organism = w.organism and l.k = w.k + 1 and l.shape is distinct from w.published) as shape) n on n.batch is not null
      ) select organism, batch, emitted as shape from walk where emitted is not null""",
    "point_lookup": _with(_EVENTS, "select batch, ordinal, organism, accession, version from firsts anti join withdrawn using (organism, accession, version) where (organism, accession, version) = (select (organism, accession, version) from entries order by organism, accession, version limit 1)"),
    "blob_store": """with n as (select count(*) as offered, count(*) filter (where p_partkey % 7 = 0) as failing, max(p_partkey) + 1 as numbers from part)
        select 'offered' as what, offered as n from n union all select 'failing', failing from n union all select 'stored', offered - failing from n union all select 'stored again', 0
        union all select 'missing', numbers - (offered - failing) from n union all select 'files', offered - failing from n union all select 'files verified', offered - failing from n""",
    "streaming_append": "select 1 as run, count(distinct event_id) as appended from events union all select 2, 0 union all select 3, 0",
    "cid": """with bits as (
        select doc_id, rpad('00000001010101010001001000100000' || array_to_string(list_transform(string_split(sha256(text), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (instr('0123456789abcdef', c) - 1) * 4 + 1, 4)), ''), 290, '0') as b from documents where text is not null)
        select doc_id, 'b' || array_to_string(list_transform(range(58), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', 1 + (16 * substr(b, i * 5 + 1, 1)::int + 8 * substr(b, i * 5 + 2, 1)::int + 4 * substr(b, i * 5 + 3, 1)::int + 2 * substr(b, i * 5 + 4, 1)::int + substr(b, i * 5 + 5, 1)::int), 1)), '') as cid from bits
        union all select doc_id, null from documents where text is null""",
    "source_matrix": _with(_AUDIT, "select source, seq, outcome from matrix"),
    "source_counters": _with(
        _AUDIT,
        """select source, count(*) as asked, count(*) filter (where outcome = 'verified')::bigint as verified, count(*) filter (where outcome = 'missing')::bigint as missing, count(*) filter (where outcome = 'corrupt')::bigint as corrupt, count(*) filter (where outcome = 'error')::bigint as error,
        count(*) filter (where outcome = 'missing' and not 970000000 - block_time < 4096 * 32 * 12)::bigint as missing_outside_retention, count(*) filter (where outcome != 'error')::bigint as answered from matrix join refs using (seq) group by source""",
    ),
    "source_judgement": _with(
        _AUDIT, "select source, count(*) as needed, count(*) filter (where outcome = 'verified')::bigint as needed_verified, count(*) = count(*) filter (where outcome = 'verified') as complete from matrix where seq not in (select seq from dead) group by source"
    ),
    "source_verdict": _with(
        _AUDIT,
        """, per as (select seq, bool_or(outcome = 'verified') as ok, count(*) filter (where outcome = 'corrupt') as bad from matrix where seq not in (select seq from dead) group by seq),
        whole as (select coalesce(bool_or(complete), true) as one from (select source, bool_and(outcome = 'verified') as complete from matrix where seq not in (select seq from dead) group by source))
        select count(*) as needed, count(*) filter (where ok)::bigint as recoverable, coalesce(sum(bad), 0)::bigint as corrupt, case when count(*) filter (where ok) < count(*) then 'broken' when coalesce(sum(bad), 0) > 0 or not (select one from whole) then 'degraded' else 'healthy' end as verdict from per""",
    ),
    "first_verified": _with(_AUDIT, "select seq, min(source) as source from found where outcome = 'verified' group by seq"),
    "source_attempts": _with(
        _AUDIT,
        """, served as (select source, count(*) as supplied from (select seq, min(source) as source from found where outcome = 'verified' group by seq) group by source),
        rows_ as (select s.source, coalesce(v.supplied, 0) as supplied, (select count(*) from refs) as n from sources s left join served v using (source)),
        run as (select source, supplied, (n - coalesce(sum(supplied) over (order by source rows between unbounded preceding and 1 preceding), 0))::bigint as wanted from rows_)
        select source, wanted, supplied, case when wanted = 0 then 'not_asked' when supplied = wanted then 'ok' when supplied > 0 then 'partial' else 'nothing' end as outcome from run""",
    ),
    "candidate_check": """select source, coalesce(count(distinct case when good then hash end), 0) as accepted, count(*) - count(distinct case when good then hash end) as rejected from (
        select p_brand as source, sha256(p_name) as hash, sha256(p_name) in (select sha256(p_name) from part where p_size >= 25) as good from part) group by source""",
    "missing_report": _with(_AUDIT, "select l.seq, string_agg(m.source || ':' || m.outcome, ',' order by m.source || ':' || m.outcome) as attempts from lost l join matrix m on m.seq = l.seq group by l.seq"),
    "dead_blobs": _with(_AUDIT, "select seq from dead"),
    "torn_tail": _with(_AUDIT, "select first_blob, last_blob from torn where first_blob = (select max(first_blob) from torn) and first_blob >= (select m from last_complete) - 100"),
    "needed_missing": _with(_AUDIT, "select seq from lost where seq not in (select seq from dead)"),
    "block_groups": _with(_AUDIT, "select block, block_time, min(seq) as first_seq, string_agg(seq::varchar, ',' order by seq) as seqs from refs group by block, block_time"),
    "hash_batches": _with(_AUDIT, "select seq, seq // 24 as hash_batch from refs"),
    "in_retention": _with(_AUDIT, "select seq, 970000000 - block_time < 4096 * 32 * 12 as kept from refs"),
    "enriched_refs": _with(_AUDIT, "select seq, hash, case when block % 2 = 0 then block when seq % 5 > 0 then block end as block from refs"),
    "lost_pins": _with(_AUDIT, "select seq, hash from refs where seq not in (select seq from found where source = 'R')"),
    "stream_totals": _with(
        f"{_EVENTS}, {_AFTER}, {_COUNTS}, {_MANIFESTS}, {_AUDIT}",
        """select (select count(*) from manifests) as batches, (select sum(raw_bytes)::bigint from manifests) as raw_bytes, (select sum(n_blobs)::bigint from manifests) as compressed_bytes,
        sum(published_total)::bigint as entries_total, sum(withdrawn_total)::bigint as withdrawn_total, (select count(*) from dead) as dead_pieces from counts where batch = (select max(batch) from counts)""",
    ),
    "human_size": f"select doc_id, {_size('n_chars')} as small, {_size('n_chars * 997')} as middle, {_size('n_chars * n_chars * 31')} as large from documents",
    "human_duration": f"""select event_id, case when {_SEC} < 120 then {_SEC} || ' s' when {_MIN} < 120 then {_MIN} || ' min' else ({_MIN} // 60) || ' h ' || ({_MIN} % 60) || ' min' end as duration,
        case when event_type = 'view' then '–' when {_AGE} < 90 then {_h(_AGE)} || ' s' when {_AGE} < 5400 then {_h(_AGE + ' / 60')} || ' min' when {_AGE} < 172800 then {_h(_AGE + ' / 3600')} || ' h' else {_h(_AGE + ' / 86400')} || ' days' end as age from events""",
    "split_key": """select tombstone_id, (generate_subscripts(accessionversions, 1) - 1)::bigint as pos, unnest(list_transform(accessionversions, lambda av: case when contains(av, '.') then regexp_extract(av, '^(.*)[.]([^.]*)$', 1) end)) as accession,
        unnest(list_transform(accessionversions, lambda av: try_cast(nullif(regexp_extract(av, '[.]([0-9]+)$', 1), '') as bigint))) as version from tombstones""",
    "safe_dirname": """select name_id, case when name in ('', '.', '..') or name like '-%' then '_' else '' end || array_to_string(list_transform(regexp_extract_all(name, '(?s).'),
        lambda c: case when regexp_full_match(c, '[A-Za-z0-9._-]') then c else '%' || lpad(upper(to_hex(unicode(c))), greatest(length(to_hex(unicode(c))), 2)::int, '0') end), '') as dirname from submitted_names""",
    "public_url": """select doc_id, 'https://host-' || coalesce(lang, 'xx') || '.example' || case when n_cells % 3 = 1 then ':8545' else '' end as url, replace('at ' || repo, 'openlab/handbook', 'openlab') as text from documents""",
    "slot": f"select row_id, floor((submittedattimestamp - {GENESIS}) / 12)::bigint as slot, strftime(to_timestamp(submittedattimestamp) at time zone 'UTC', '%Y-%m-%d') as day, (load_no * 12 + 960)::bigint as seconds from zika_metadata",
    "hashes": "select doc_id, sha256(text) as sha256, '0x' || lower(hex(path)) as hex, path as back from documents",
    "blob_pack": "select file_id, ceil(strlen(doc) / 126976.0)::bigint as blobs, sha256(doc) as sha256 from vector_docs where doc != ''",
    "blob_counts": """select doc_id, ceil(n / 126976.0)::bigint as blobs, (ceil(n / 31.0) - (ceil(ceil(n / 31.0) / 4096) - 1) * 4096)::bigint as last_chunks, n // 31 // 4096 as blob, n // 31 % 4096 as element
        from (select doc_id, n_chars * 37 as n from documents where n_chars > 0)""",
}
ORACLE["bytes_since_index"] = (
    ORACLE["index_placement"].replace("select batch, size, since_index, since_index", "select batch, (sum(size) over (partition by g order by batch))::bigint as bytes from (select *, coalesce(sum(has_index::int) over (order by batch rows between unbounded preceding and 1 preceding), 0) as g from (select batch, size, since_index, since_index")
    + "))"
)
ORACLE = {k: v for k, v in ORACLE.items() if v}

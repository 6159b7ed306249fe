"""DuckDB SQL for the queries. Where the texts are rendered receipts, the expected values come
from the source columns and no pattern is matched."""

from __future__ import annotations

from tillroll.functions.text import BLANKS, LINE_ENDS
from workload.receipts import TEXTS_SQL

# Files and their true fields, one row per rendered text.
_TRUTH = """
with priced as (
  select l_orderkey k, max(l_extendedprice) dearest, count(*) n,
    list(struct_pack(description := p_name, amount := l_extendedprice)
         order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) items
  from lineitem join part on l_partkey=p_partkey group by 1),
o as (
  select o_orderkey k, c_name, strftime(o_orderdate,'%Y-%m-%d') iso, cast(o_orderdate as date) odate,
    o_totalprice price,
    round(case when o_orderkey%17=0 then o_totalprice+1 else floor(o_totalprice*8)/100.0 end, 2) tax,
    substr('$£€₱¥',cast(o_orderkey%5 as int)+1,1) sym, dearest, coalesce(n,0) n, items,
    'r_'||lpad(cast(o_orderkey as varchar),20,'0') stem
  from orders join customer on o_custkey=c_custkey left join priced on priced.k=o_orderkey),
f as (
  select *, stem||'.txt' source_file, 'base' kind, k%13=0 blank from o
  union all select *, stem||'_copy.txt', 'copy', k%13=0 from o where k%7=0
  union all select *, stem||'_scan.txt', 'scan', false from o where k%11=0 and k%10<>3 and k%13<>0),
u as (
  select k, source_file, kind, blank, stem, iso, odate, price,
    case when not blank then case when kind='scan' then upper(c_name) else c_name end end vendor,
    case when not blank then iso end "date",
    case when not blank and (kind='scan' or k%10<>3) then price end labelled,
    case when not blank then case when kind<>'scan' and k%10=3
      then greatest(coalesce(dearest,0), price, tax) else price end end total,
    case when not blank and kind<>'scan' then tax end tax,
    case when not blank then sym end currency,
    case when not blank and kind<>'scan' then n else 0 end n_items,
    case when not blank and kind<>'scan' then items end items,
    (not blank and kind<>'scan' and k%10=3) fell_back
  from f),
t as (
  select *, coalesce(tax > total, false) over_total,
    case when blank and source_file <> 'r_00000000000000000000.txt' then 'r_00000000000000000000.txt'
         when not blank and kind<>'base' then stem||'.txt' end duplicate_of,
    case when blank then ['could not read any text'] else list_concat(['read via text'],
      case when fell_back then ['total not labelled; used largest amount on receipt'] else [] end,
      case when coalesce(tax > total, false)
        then ['tax is greater than total — check this row'] else [] end) end warned
  from u),
m as (
  select *, list_concat(warned,
      case when duplicate_of is not null then ['duplicate of '||duplicate_of] else [] end) warnings,
    case when duplicate_of is not null then 'duplicate_of: '||duplicate_of
         when total is null then 'no_data_extracted: '||array_to_string(warned,'; ') end reason
  from t)
"""
_TEXTS = f"texts as ({TEXTS_SQL})"

_CREATED_AT = "timestamp '2026-01-05 00:00:00'"

# Events as processed files.
_EVENTS = f"""
with e as (
  select 'event_'||lpad(cast(event_id as varchar),20,'0') source_file,
    'user_'||user_id vendor, strftime(ts,'%Y-%m-%d') "date", value total,
    event_type='error' failed, event_id,
    cast(floor(epoch(ts)/900) as bigint) run_id,
    case when event_type='error' then 'extraction_failed: event error'
         when value is null then 'no_data_extracted: event '||event_type end reason
  from events),
runs as (
  select run_id, to_timestamp(run_id*900)::timestamp started_at, count(*) files_processed,
    count(reason) flagged_count, cast(0 as bigint) duplicate_count, 'rule_based' engine
  from e group by run_id),
flagged as (select source_file, vendor, "date", total, reason, {_CREATED_AT} created_at, run_id,
    event_id%3=0 reviewed from e where reason is not null)
"""

# Replies and attempts by order.
_REPLIES = """
with r as (
  select o_orderkey k, 'r_'||lpad(cast(o_orderkey as varchar),20,'0')||'.png' source_file, c_name,
    strftime(o_orderdate,'%Y-%m-%d') iso, o_totalprice price, o_orderpriority,
    case when o_orderkey%11=4 then 'nope' when o_orderkey%11=5 then '[1]' else concat(
      case when o_orderkey%2=0 then '```json'||chr(10) else '' end,
      '{"vendor": "  ',c_name,' ", "date": "',strftime(o_orderdate,'%Y-%m-%d'),'", "total": ',
      case when o_orderkey%3=0 then '"$'||format('{:,.2f}',o_totalprice)||'"'
           when o_orderkey%3=1 then format('{:.2f}',o_totalprice) else '"USD 5"' end,
      ', "tax": ', case when o_orderkey%5=0 then 'true' else '1.5' end,
      ', "currency": ', case when o_orderkey%7=0 then 'null' else '"EUR"' end,
      ', "line_items": [{"description": " ',o_orderpriority,'", "amount": "1,000.50"}, "junk"]}',
      case when o_orderkey%2=0 then chr(10)||'```' else '' end) end reply
  from orders join customer on o_custkey=c_custkey),
kinds as (
  select *, case when k%23=0 then 'denied' when k%19=0 then 'retried' when k%29=0 then 'empty'
                 when k%31=0 then 'down' else 'good' end kind from r),
a as (
  select source_file, k, k%16 run_id, k*10 seq, reply,
    case kind when 'denied' then 400 when 'retried' then 429 when 'empty' then 200
              when 'down' then 0 else 200 end status,
    case kind when 'denied' then 'failed' when 'retried' then 'retryable' when 'empty' then 'failed'
              when 'down' then 'retryable' else 'done' end outcome,
    case kind when 'denied' then 'bad key' when 'retried' then 'RESOURCE_EXHAUSTED'
              when 'empty' then 'response contained no text' when 'down' then 'network error' end message
  from kinds
  union all
  select source_file, k, k%16, k*10+1, reply, case when kind='retried' then 200 else 503 end,
    case when kind='retried' then 'done' else 'retryable' end,
    case when kind='down' then 'no error detail returned' end
  from kinds where kind in ('retried','down')),
last as (
  select * from a qualify row_number() over
    (partition by source_file order by (outcome='done') desc, seq desc) = 1),
parsed as (
  select source_file, k,
    case when k%11 not in (4,5) then c_name end vendor,
    case when k%11 not in (4,5) then iso end "date",
    case when k%11 not in (4,5) and k%7<>0 then 'EUR' end currency,
    case when k%11 not in (4,5) and k%3<>2 then price end total,
    case when k%11 not in (4,5) and k%5<>0 then 1.5::double end tax,
    cast(case when k%11 not in (4,5) then 1 else 0 end as bigint) items,
    case when k%11 not in (4,5) then o_orderpriority end description,
    case when k%11 not in (4,5) then 1000.5::double end amount,
    case when k%11=4 then 'AI reply was not valid JSON' when k%11=5 then 'AI reply was not a JSON object'
         else '' end warnings
  from r)
"""

# Free text, read with DuckDB's own functions. RE2 needs the characters spelled out.
_CHARS = "concat(" + ",".join(f"chr({ord(c)})" for c in BLANKS) + ")"
_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS)
_ENDS = "".join(f"\\x{{{ord(c):x}}}" for c in LINE_ENDS)
_INLINE = "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS if c not in LINE_ENDS)
_WHOLE = r"\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}{1,2})?|\p{Nd}+(?:\.\p{Nd}{1,2})?"
_SPLIT = r"\p{Nd}{1,3}(?:,\p{Nd}{3})*(?:\.\p{Nd}{1,2})?"


def _money_list(text: str, number: str, blanks: str = _CLASS) -> str:
    found = f"regexp_extract_all({text}, '((?:[$£€₱¥][{blanks}]*)?(?:{number}))', 1)"
    return (
        f"list_transform(list_filter({found}, lambda x: contains(x,'.') or regexp_matches(x,'[$£€₱¥]')),"
        f" lambda x: cast(regexp_replace(x,'[^0-9.]','','g') as double))"
    )


_DOCUMENTS = f"""
with d as (
  select *, 'doc_'||lpad(cast(doc_id as varchar),20,'0')||'.txt' source_file,
    list_filter(list_transform(regexp_split_to_array(text,'[{_ENDS}]'), lambda x: trim(x,{_CHARS})),
                lambda x: x <> '') lines
  from documents)
"""

_FOUND = f"(?:[$£€₱¥][{_INLINE}]*)?(?:{_WHOLE})"
_LETTERS = "length(regexp_replace({}, '\\P{{L}}', '', 'g'))"

# Per line: its words, the money on it, and the text before the last money, found by adding up
# the lengths of what lies between the numbers.
_DOCUMENT_LINES = f"""{_DOCUMENTS},
l1 as (select source_file, unnest(lines) line, unnest(range(1, len(lines)+1)) line_no from d),
l2 as (select *, lower(line) low, regexp_extract_all(line, '({_FOUND})', 1) found,
         string_split_regex(line, '{_FOUND}') between from l1),
l3 as (select *, list_max(list_filter(range(1, len(found)+1),
         lambda i: contains(found[i],'.') or regexp_matches(found[i],'[$£€₱¥]'))) last_no from l2),
l as (select *,
    case when last_no is not null then cast(regexp_replace(found[last_no],'[^0-9.]','','g') as double) end amount,
    case when last_no is not null then substr(line, 1, cast(
      coalesce(list_sum(list_transform(between[1:last_no], lambda x: length(x))),0)
      + coalesce(list_sum(list_transform(found[1:last_no-1], lambda x: length(x))),0) as int)) end head,
    contains(low,'total') or contains(low,'amount due') or contains(low,'balance due') is_total,
    contains(low,'tax') or contains(low,'vat') or contains(low,'gst') is_tax,
    contains(low,'subtotal') is_sub, contains(low,'grand total') is_grand,
    regexp_matches(low,'receipt|invoice|order|date|time') skipped
  from l3),
g as (select source_file,
    max_by(amount, line_no) filter (amount is not null and is_total and (not is_sub or is_grand)) labelled,
    max_by(amount, line_no) filter (amount is not null and is_tax) tax,
    min_by(line, line_no) filter (line_no <= 6 and amount is null and not skipped
      and {_LETTERS.format('line')} >= 3) vendor,
    count(*) filter (amount is not null and not is_total and not is_tax and not is_sub
      and {_LETTERS.format('head')} >= 2) items
  from l group by 1)
"""


def _amount_rows(number: str) -> str:
    return f"""{_DOCUMENTS}, x as (select source_file, {_money_list('text', number)} a from d)
select source_file, cast(i as bigint) amount_no, a[i] amount
from (select source_file, a, unnest(range(1, len(a)+1)) i from x)"""


ORACLES: dict[str, str] = {
    "discover_files": """
with n as (select doc_id, 'd'||doc_id||(['.pdf','.PNG','.txt','.docx','.Jpeg','','.tar.heic'])[doc_id%7+1] source_file
           from documents)
select source_file, case doc_id%7 when 0 then 'pdf' when 2 then 'text' else 'image' end file_kind
from n where doc_id%7 not in (3,5)""",
    "content_hash": "select 'doc_'||lpad(cast(doc_id as varchar),20,'0')||'.txt' source_file, md5(text) content_hash from documents",
    "latest_upload": """
select 'user_'||user_id||'.png' source_file, ts arrived_at, event_id seq, value from events
qualify row_number() over (partition by user_id order by ts desc, event_id desc)=1""",
    "choose_text": f"""
with c as (select doc_id, text,
    case when doc_id%3=0 then ' '||source||chr(10) else chr(10)||chr(9)||text||'  ' end direct_text from documents),
s as (select *, trim(direct_text,{_CHARS}) direct from c)
select 'doc_'||lpad(cast(doc_id as varchar),20,'0')||'.txt' source_file,
  case when length(direct)>=20 then 'pdf_text' else 'pdf_ocr' end "method",
  md5(case when length(direct)>=20 then direct else text end) text_hash from s""",
    "unreadable_rows": f"""{_TRUTH}
select source_file, blank unreadable, false extraction_failed, blank no_total, n_items items from t""",
    "preview": f"""{_TRUTH}
select source_file, vendor, total from t order by source_file limit 100""",
    "report_rows": f"""{_TRUTH}
select source_file "Source File", coalesce(vendor,'') "Vendor", coalesce("date",'') "Date",
  coalesce(currency,'') "Currency", coalesce(cast(total as varchar),'') "Total",
  coalesce(cast(tax as varchar),'') "Tax",
  coalesce(array_to_string(list_transform(items, lambda x: x.description||' ('||cast(x.amount as varchar)||')'),'; '),'') "Line Items",
  coalesce(duplicate_of,'') "Duplicate Of", 'rule_based' "Engine", array_to_string(warnings,'; ') "Warnings" from m""",
    "receipt_lines": f"""
with {_TEXTS}, l as (select source_file, list_filter(string_split(text,chr(10)), lambda x: x<>'') a from texts)
select source_file, cast(i as bigint) line_no, a[i] line
from (select source_file, a, unnest(range(1,len(a)+1)) i from l)""",
    "document_lines": f"""{_DOCUMENTS}
select source_file, cast(len(lines) as bigint) lines,
  cast(list_sum(list_transform(lines, lambda x: length(x))) as bigint) chars from d where len(lines)>0""",
    "currency": f"{_TRUTH} select source_file, currency from t",
    "amounts": f"""{_TRUTH},
a as (select source_file, case when blank then [] when kind='scan' then [price] else
    list_concat(coalesce(list_transform(items, lambda x: x.amount),[]), [price, tax],
                case when k%10<>3 then [price] else [] end) end a from t)
select source_file, cast(i as bigint) amount_no, a[i] amount
from (select source_file, a, unnest(range(1,len(a)+1)) i from a)""",
    "document_amounts": _amount_rows(_WHOLE),
    "document_amounts_split": _amount_rows(_SPLIT),
    "total": f"{_TRUTH} select source_file, labelled total from t",
    "tax": f"{_TRUTH} select source_file, tax from t",
    "vendor": f"{_TRUTH} select source_file, vendor from t",
    "total_fallback": f"{_TRUTH} select source_file, total, fell_back from t",
    "date": f"""{_TRUTH} select source_file, "date", case when not blank then odate end date_typed from t""",
    "date_dayfirst": f"""{_TRUTH} select source_file,
  case when not blank and kind<>'scan' and k%4=1 and day(odate)<=12 then strftime(odate,'%Y-%d-%m') else "date" end "date" from t""",
    "line_items": f"""{_TRUTH}
select source_file, cast(i as bigint) item_no, items[i].description description, items[i].amount amount
from (select source_file, items, unnest(case when n_items=0 then [null] else range(1,n_items+1) end) i from t)""",
    "missing_fields": f"""{_TRUTH}
select source_file, case when blank then 'vendor; date; total' else '' end missing from t""",
    "receipts": f"""{_TRUTH}, {_TEXTS}
select source_file, vendor, "date", total, tax, currency, n_items items, 'rule_based' engine,
  array_to_string(warned,'; ') warnings, md5(text) content_hash, false extraction_failed
from t join texts using (source_file)""",
    "warnings": f"""{_TRUTH}
select source_file, cast(i as bigint) warning_no, warnings[i] warning
from (select source_file, warnings, unnest(range(1,len(warnings)+1)) i from m)""",
    "document_receipts": f"""{_DOCUMENT_LINES},
w as (select *, list_max({_money_list('text', _WHOLE)}) largest from d)
select source_file,
  md5(nullif(trim(regexp_replace(vendor,'[{_CLASS}]+',' ','g')),'')) vendor_hash,
  case when contains(text,'$') then '$' when contains(text,'£') then '£' when contains(text,'€') then '€'
       when contains(text,'₱') then '₱' when contains(text,'¥') then '¥' end currency,
  coalesce(labelled, largest) total, tax, coalesce(items,0) items,
  labelled is null and largest is not null fell_back
from w left join g using (source_file)""",
    "clean_text_values": f"""
select 'doc_'||lpad(cast(doc_id as varchar),20,'0')||'.txt' source_file,
  md5(nullif(trim(regexp_replace(text,'[{_CLASS}]+',' ','g')),'')) cleaned_hash from documents""",
    "tax_over_total": f"{_TRUTH} select source_file, total, tax from t where over_total",
    "normalized": """
with o as (select *, o_totalprice price,
    case when o_orderkey%2=0 then o_totalprice when o_orderkey%3=0 then round(o_totalprice+1.25,2) end tax from orders)
select cast(o_orderkey as varchar) source_file, o_orderpriority||' x' vendor, price total, tax,
  case when tax>price then 'w; tax is greater than total — check this row' else 'w' end warnings,
  case when o_orderkey%2=0 then o_orderstatus||' y' else '' end description from o""",
    "reply_text": f"""{_REPLIES}
select source_file, seq, case when outcome='done' then md5(reply) end reply_hash from a""",
    "provider_error": f"""{_REPLIES}
select source_file, seq, case when status=200 then 'no error detail returned' else message end error from a""",
    "call_outcome": f"{_REPLIES} select source_file, seq, outcome, message from a",
    "resolve_attempts": f"{_REPLIES} select source_file, seq, cast(status as int) status, outcome from last",
    "failure_scope": f"""{_REPLIES},
s as (select *, min(seq) filter (outcome='done') over (partition by run_id) first_done from last)
select run_id, source_file, outcome, case when outcome='done' then null
  when first_done is null or seq<first_done then 'systemic' else 'single' end scope from s""",
    "reply_receipts": f"""{_REPLIES}
select l.source_file, case when outcome='done' then vendor end vendor,
  case when outcome='done' then total end total, outcome<>'done' extraction_failed,
  case when outcome<>'done' then 'extraction_failed: AI vision failed for this file — HTTP '||status||': '||message
       when total is null then 'no_data_extracted: '||coalesce(nullif(warnings,''),'no total extracted') end reason
from last l join parsed using (source_file)""",
    "parse_replies": f"""{_REPLIES}
select source_file, vendor, "date", currency, total, tax, items, description, amount, warnings,
  false extraction_failed from parsed
union all
select 'n_'||lpad(cast(o_orderkey as varchar),20,'0')||'.png',
  case when o_orderkey%5<>0 then ['nan','NaN, " Infinity','-inf','x'][o_orderkey%4+1] end,
  case when o_orderkey%5<>0 then 'Infinity' end, case when o_orderkey%5=1 then 'inf' end,
  case when o_orderkey%5<>0 then o_totalprice end, null,
  case when o_orderkey%5<>0 then 1 else 0 end, case when o_orderkey%5<>0 then 'inf' end,
  case when o_orderkey%5<>0 then 2.0 end,
  case when o_orderkey%5=0 then 'AI reply was not valid JSON' else '' end, false
from orders""",
    "clean_number": """
select o_orderkey, case o_orderkey%8 when 0 then o_totalprice
  when 1 then cast(format('{:.1f}',o_totalprice) as double)
  when 5 then o_orderkey*100.0 when 7 then -100.0-o_orderkey%10 end::double number from orders""",
    "duplicates_by_hash": """
with d as (select 'doc_'||lpad(cast(doc_id as varchar),20,'0')||'.txt' source_file, md5(text) content_hash from documents),
w as (select *, min(source_file) over (partition by content_hash) first_file from d)
select source_file, content_hash, nullif(first_file, source_file) duplicate_of from w""",
    "fingerprint": f"""{_TRUTH}
select source_file, case when not blank
  then md5(concat_ws(' ', length(vendor), length("date"), lower(vendor), "date",
    cast(round(total*100) as bigint))) end fingerprint from t""",
    "mark_duplicates": f"""{_TRUTH}
select source_file, duplicate_of, array_to_string(warnings,'; ') warnings from m""",
    "mark_duplicates_any": """
with k as (select 'm_'||lpad(cast(o_orderkey as varchar),20,'0') n from orders),
p as (select n, unnest(['a','b','c','d','e','f','z']) part from k),
d as (select n||'_'||part source_file, case part when 'b' then n||'_a' when 'd' then n||'_c'
   when 'e' then n||'_c' when 'z' then (select min(n)||'_z' from k) end first_file from p),
o as (select source_file, nullif(first_file, source_file) duplicate_of from d)
select source_file, duplicate_of, 'read'||coalesce('; duplicate of '||duplicate_of,'') warnings from o""",
    "duplicates_across_runs": f"""{_TRUTH}
select cast(case when kind='base' then 1 else 2 end as bigint) run_id, source_file, duplicate_of from t
union all
select r, stem||x||'.txt', coalesce(duplicate_of, source_file)
from t, (values (3::bigint, '_again'), (4::bigint, '_blank')) v(r, x) where kind='base'""",
    "rerun_responses": f"""{_REPLIES},
n as (
  select v.run_id, p.*, d.kind from parsed p join kinds d using (k), (values (1::bigint), (2::bigint)) v(run_id)),
w as (
  select *, kind in ('good','retried') known, kind in ('good','retried') or (run_id=2 and kind='empty') done from n)
select run_id, case run_id when 1 then source_file else 's_'||substr(source_file,3) end source_file,
  case when known then vendor when done then 'late' end vendor, case when known then total end total,
  not done extraction_failed,
  case when known and run_id=2 then 'loaded from checkpoint (not re-sent to AI)'||case when warnings='' then '' else '; '||warnings end
    when known then warnings when done then ''
    else 'AI vision failed for this file — '||case
      when kind='denied' and run_id=1 then 'HTTP 400: bad key'
      when kind='empty' then 'HTTP 200: response contained no text'
      when kind='down' and run_id=2 then 'no response'
      else 'HTTP 503: no error detail returned' end end warnings
from w""",
    "run_with_repeated_names": f"""{_TRUTH}
select 3::bigint run_id, source_file, vendor, total, duplicate_of from t""",
    "stream_last_uploads": f"""{_TRUTH}
select case when kind='base' and k%2=0 then 1 else 0 end::bigint run_id, source_file,
  case when kind='base' and k%2=0 then 'Replaced Shop' else vendor end vendor,
  case when kind='base' and k%2=0 then 9.99 else total end total from t""",
    "stored_runs": f"""{_TRUTH},
-- Within a run the first blank text is the one the others repeat.
w as (select *, case k%3 when 0 then 5 when 1 then 7 else 8 end::bigint run_id from m where k%3<>0 or k%2=0),
b as (select *, min(source_file) filter (blank) over (partition by run_id) first_blank from w),
d as (select *, case when blank then nullif(first_blank, source_file) else duplicate_of end found from b)
select run_id, source_file, found duplicate_of,
  case when found is not null then 'duplicate_of: '||found
       when total is null then 'no_data_extracted: '||array_to_string(warned,'; ') end reason
from d""",
    "reuse_cached": f"""{_TRUTH},
c as (select *, case when blank then (select max(k) from t where kind='base' and blank and k%3=1)
   when kind<>'scan' and k%3<>0 then k end stored from t)
select source_file, vendor, total,
  case when not blank and k%3=1 then currency when not blank then 'old' end currency,
  'loaded from checkpoint (not re-sent to AI)' warning
from c where stored is not null""",
    "pending_files": f"""{_TRUTH}
select source_file from t where not blank and (kind='scan' or (kind='base' and k%3=0))""",
    "cache_updates": f"""{_TRUTH}
select source_file, vendor, total, cast(3 as bigint) run_id from t
where k%5<>0 and not blank and kind<>'copy'
union all
select min(source_file), null, null, 3 from t where k%5<>0 and blank""",
    "json_round_trip": f"""{_TRUTH}
select source_file, vendor, "date", currency, total, tax, n_items items, array_to_string(warned,'; ') warnings from t""",
    "review_flags": f"{_TRUTH} select source_file, reason from m",
    "run_summary": f"""{_TRUTH}
select count(*) files_processed, count(reason) flagged_count, count(duplicate_of) duplicate_count from m""",
    "run_summary_by_tick": f"""{_EVENTS}
select run_id, files_processed, flagged_count, duplicate_count from runs""",
    "flagged_items": f"""{_TRUTH}
select source_file, vendor, "date", total, reason, {_CREATED_AT} created_at, cast(7 as bigint) run_id
from m where reason is not null""",
    "recent_runs": f"{_EVENTS} select * from runs order by run_id desc limit 50",
    "review_queue": f"{_EVENTS} select * from flagged",
    "unreviewed_queue": f"{_EVENTS} select * from flagged where not reviewed",
    "flagged_by_id": f"""{_EVENTS}
select f.source_file, f.vendor, f.total, f.reason, f.reviewed from e left join flagged f using (source_file)""",
    "apply_reviews": f"""{_EVENTS}
select source_file, reason is not null known from e where event_id%3=0""",
    "review_stats": f"""{_EVENTS}
select (select cast(sum(files_processed) as bigint) from runs) files_processed,
  (select count(*) from flagged) flagged_items,
  (select count(*) from flagged where not reviewed) awaiting_review,
  (select max(started_at) from runs) last_run""",
    "alerts": f"""{_EVENTS}
select flagged_count||' receipt(s) need review — run #'||run_id||'. Check the dashboard: table flagged' "text",
  flagged_count, run_id from runs where flagged_count>0""",
    "stream_receipts": f"""{_TRUTH}
select cast(0 as bigint) run_id, source_file, vendor, "date", total, duplicate_of, reason from m""",
    "stream_alerts": f"""{_TRUTH},
s as (select k%3 run_id, count(*) flagged_count from t
      where blank or duplicate_of is not null group by 1)
select flagged_count||' receipt(s) need review — run #'||run_id||'. Check the dashboard: table flagged' "text",
  flagged_count, run_id from s""",
}

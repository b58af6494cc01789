"""DuckDB SQL for the query catalogue: an independent formulation of each query over the same tables.

Nothing is taken from the operators: word lists, patterns and times are stated here once more.
"""

from __future__ import annotations

# White space, line ends, words and patterns of the data contract.
BLANKS = "\\t\\n\\x0B\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\u0085\u2028\u2029]"
NUMBER = r"\b(\d+\.?\d*)\b"
CALL = r"\b([A-Za-z_]\w*)\s*\("
PYTHON_LINES = ("if ", "elif ", "for ", "while ", "except ", "and ", "or ")
JAVA_LINES = ("if ", "else if", "for ", "while ", "catch ", "&&", "||", "case ")
PYTHON_WORDS = "def|class|if|elif|else|for|while|return|import|from|as|try|except|finally|with|yield|lambda|pass|break|continue|and|or|not|in|is|True|False|None|print|self|raise|del|global|nonlocal|assert"
JAVA_WORDS = "public|private|protected|static|final|class|interface|extends|implements|void|int|double|float|boolean|String|char|long|short|byte|if|else|for|while|do|switch|case|break|continue|return|new|this|super|try|catch|finally|throw|throws|import|package|null|true|false|abstract|synchronized"
NOW, EVENTS_NOW = "2024-06-01 00:00:00", "2024-01-20 12:00:00"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def key(x: str) -> str:
    return f"nullif(lower({trim(x)}), '')"


def once(table: str, columns: str) -> str:
    return f"(select {columns} from (select *, row_number() over (partition by id order by created_at) as once_rn from {table}) where once_rn = 1)"


LINES_OF = f"greatest(1, len(regexp_split_to_array(coalesce(TEXT, ''), '{END}')) - case when regexp_matches(coalesce(TEXT, ''), '(?:{END})\\z') then 1 else 0 end)"


def _points(words: tuple[str, ...]) -> str:
    return " + ".join(f"case when contains(line, '{w}') then 1 else 0 end" for w in words)


def metrics(source: str, key_column: str, text: str, language: str) -> str:
    """CTEs ending in m: one row per document with all metrics."""
    return f"""
    src as (select {key_column} as k, {text} as t, {language} as lang from {source}),
    parts as (select k, lang, unnest(string_split(coalesce(t, ''), chr(10))) as line from src),
    solid as (select k, line, {trim('line')} as tl, case when lang = 'python' then {_points(PYTHON_LINES)} else {_points(JAVA_LINES)} end as pts from parts where length({trim('line')}) > 0),
    per as (select k, count(*) as total_lines, sum(pts) as pts from solid group by k),
    dup as (select k, sum(c - 1) as d from (select k, tl, count(*) as c from solid where length(tl) > 5 group by k, tl) group by k),
    base as (select src.k as id, cast(coalesce(total_lines, 0) as bigint) as total_lines, cast(coalesce(d, 0) as bigint) as duplicate_lines, cast(1 + coalesce(pts, 0) as bigint) as cyclomatic_complexity
             from src left join per on src.k = per.k left join dup on src.k = dup.k),
    m0 as (select *, case when total_lines > 0 then floor(cast(duplicate_lines as double) / total_lines * 1000 + 0.5) / 10 else 0.0 end as clone_percentage from base),
    m as (select *, cast(greatest(0, least(100, floor(100.0 - 2 * cyclomatic_complexity - 0.5 * clone_percentage + 0.5))) as bigint) as maintainability_index from m0)"""


LANG = f"lower({trim('language')})"
CODE = metrics(once("analyses", "id, language, code"), "id", "code", LANG)
DOCS = metrics("documents", "doc_id", "text", "'python'")
RESULTS = f"res as (select id, lower({trim('language')}) as section, {key('user_id')} as member, clone_percentage, cyclomatic_complexity, maintainability_index from {once('analyses', '*')})"
SECTION = "coalesce(nullif(section, ''), 'Unassigned')"
MEANS = f"means as (select {SECTION} as grp, coalesce(member, '(none)') as member, cast(round(avg(coalesce(clone_percentage, 0)), 4) as double) as mean_value from res group by all)"
SCORE = "cast(greatest(5, least(95, floor((A + B) / 2 + 0.5))) as bigint)"
STATUS = "case when S > 70 then 'high' when S > 40 then 'medium' else 'low' end"
AGE = """case when TS is null then null when s < 60 then 'Just now'
  when s < 3600 then cast(s // 60 as varchar) || ' minute' || case when s // 60 > 1 then 's' else '' end || ' ago'
  when s < 86400 then cast(s // 3600 as varchar) || ' hour' || case when s // 3600 > 1 then 's' else '' end || ' ago'
  when s // 86400 = 1 then 'Yesterday' when s // 86400 < 7 then cast(s // 86400 as varchar) || ' days ago'
  when s // 86400 < 14 then '1 week ago' else cast(s // 604800 as varchar) || ' weeks ago' end"""
RICH = "(select distinct o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 400000)"


def _kw(words: str) -> str:
    return f"len(regexp_extract_all(t, '\\b({words})\\b'))"


def _comments(mark: str) -> str:
    return f"len(regexp_extract_all(t, '(?m)^[{BLANKS}]*{mark}'))"


def normalised(x: str) -> str:
    words = f"{PYTHON_WORDS}|{JAVA_WORDS}"
    for a, b in ((r"\"[^\"]*\"|''[^'']*''", "§"), (rf"\b({words})\b", r"¤\1"), (r"(^|[^\w¤])[A-Za-z_]\w*", r"\1N"), (r"(^|\W)\d[\w.]*", r"\g0"), (r"\s+", "")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')" if b != r"\g0" else f"regexp_replace({x}, '{a}', '\\10', 'g')"
    return f"replace(replace({x}, '¤', ''), '§', 'S')"


_BASE = "string_split(coalesce(name, ''), '/')[-1]"
_STEM = f"translate(regexp_replace({_BASE}, '(?i)\\.(py|java|txt)$', ''), '_-', '  ')"

P2 = f"""
  refs as (select distinct 'analyses' as table_name, id as record_id, {key('user_id')} as k, created_at, 'users' as entity from analyses
           union all select distinct 'students', id, {key('section_id')}, created_at, 'sections' from students
           union all select distinct 'sections', id, {key('instructor_id')}, created_at, 'users' from sections),
  parents as (select 'users' as entity, {key('id')} as k, min(coalesce(created_at, timestamp '0001-01-01')) as born from users group by all
              union all select 'sections', {key('id')}, min(coalesce(created_at, timestamp '0001-01-01')) from sections group by all),
  gone as (select distinct entity, {key('entity_id')} as k from removals where restored_at is null),
  states as (select table_name, record_id, r.created_at, case when g.k is not null then 'deleted' when p.k is null then 'missing' when p.born > r.created_at then 'late' else 'ok' end as state
             from refs r left join parents p on p.entity = r.entity and p.k = r.k left join gone g on g.entity = r.entity and g.k = r.k where r.k is not null)"""

KIND = f"lower({trim('file_type')})"
# three or one quotes of either kind, up to the first such quote that is not escaped
LITERALS = r"(?s)\"{3}(?:\\[^\n\r]|.)*?\"{3}|''{3}(?:\\[^\n\r]|.)*?''{3}|\"(?:\\[^\n\r]|[^\"])*?\"|''(?:\\[^\n\r]|[^''])*?''"

ORACLES: dict[str, str] = {
    "q01_duplicate_lines": f"with {DOCS} select id as doc_id, total_lines, duplicate_lines, clone_percentage from m",
    "q02_complexity": f"with {CODE} select id, cyclomatic_complexity from m",
    "q03_maintainability": f"with {CODE} select id, clone_percentage, maintainability_index from m",
    "q04_clone_pairs": f"""with p as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
      s as (select doc_id, {trim('line')} as t, row_number() over (partition by doc_id order by pos) as rl from p where length({trim('line')}) > 0),
      f as (select *, min(rl) over (partition by doc_id, t) as fl from s where length(t) > 10),
      r as (select *, row_number() over (partition by doc_id order by rl) as pair_no from f where rl > fl)
      select doc_id, cast(pair_no as bigint) as pair_no, cast(fl as bigint) as first_line, cast(rl as bigint) as repeat_line from r where pair_no <= 5""",
    "q05_suggestions": f"with {CODE} select id, 'Extract Method' as refactoring_type, cast(1 as bigint) as priority from m where clone_percentage > 10 union all select id, 'Simplify Conditionals', 2 from m where cyclomatic_complexity > 10",
    "q06_class_histogram": f"""with {CODE}, c as (
      select 'clone' as metric, case when clone_percentage > 50 then 'high' when clone_percentage > 25 then 'medium' else 'low' end as class from m
      union all select 'complexity', case when cyclomatic_complexity > 20 then 'high' when cyclomatic_complexity > 10 then 'medium' else 'low' end from m
      union all select 'maintainability', case when maintainability_index >= 60 then 'good' when maintainability_index >= 30 then 'medium' else 'low' end from m)
      select metric, class, count(*) as documents from c group by all""",
    "q07_line_count": f"select doc_id, cast({LINES_OF.replace('TEXT', 'text')} as bigint) as lines_of_code from documents",
    "q08_outline_spans": f"""with n as (select doc_id, cast({LINES_OF.replace('TEXT', 'text')} as bigint) as c from documents)
      select doc_id, cast(1 as bigint) as span_no, greatest(1, c // 4) as start_line, greatest(5, c // 4 + 5) as end_line from n where c >= 6
      union all select doc_id, 2, greatest(1, c // 2), greatest(5, c // 2 + 5) from n where c >= 6""",
    "q09_section_summary": f"with {RESULTS} select {SECTION} as section, count(*) as results, cast(floor(avg(coalesce(clone_percentage, 0)) + 0.5) as bigint) as mean_value, cast(count(distinct member) + max(case when member is null then 1 else 0 end) as bigint) as members from res group by 1",
    "q10_section_analytics": f"""with {RESULTS}, g as (select {SECTION} as section, count(*) as files, cast(round(avg(coalesce(cast(clone_percentage as decimal(18,6)), 0)), 1) as double) as avg_clone, cast(round(avg(coalesce(cast(cyclomatic_complexity as decimal(18,6)), 0)), 1) as double) as avg_complexity,
      cast(round(avg(coalesce(cast(maintainability_index as decimal(18,6)), 0)), 1) as double) as avg_maintainability, count(*) filter (where clone_percentage > 30) as high_clone_files from res group by 1)
      select *, case when avg_clone > 30 then 'high' when avg_clone > 15 then 'medium' else 'low' end as clone_class from g""",
    "q11_member_pairs": f"""with {RESULTS}, {MEANS}, b as (select grp, member, cast(round(mean_value * 10000) as bigint) as v from means),
      p as (select x.grp, greatest(5, least(95, (x.v + y.v + 10000) // 20000)) as s from b x join b y on x.grp = y.grp and x.member < y.member)
      select grp, {STATUS.replace('S', 's')} as status, cast(count(*) as bigint) as pairs from p group by all""",
    "q11_high_pairs": f"""with {RESULTS}, {MEANS}, p as (select x.grp, x.member as member_a, y.member as member_b, {SCORE.replace('A', 'x.mean_value').replace('B', 'y.mean_value')} as similarity from means x join means y on x.grp = y.grp and x.member < y.member and x.mean_value + y.mean_value >= 80)
      select *, {STATUS.replace('S', 'similarity')} as status from p where similarity > 40""",
    "q12_pair_keys": "with o as (select o_orderkey, 'c' || cast(o_custkey as varchar) as a, 'c' || cast(o_orderkey as varchar) as b from orders) select least(a, b) || '|' || greatest(a, b) as pair_key, min(o_orderkey) as o_orderkey from o where a <> b group by 1",
    "q13_file_owner": f"""with f as (select id as file_id, lower({_STEM}) as stem from {once('uploaded_files', '*')}),
      p as (select id, lower(coalesce(name, '')) as n, split_part(lower(coalesce(name, '')), ' ', 1) as first, lower(split_part(coalesce(email, ''), '@', 1)) as local from {once('students', '*')})
      select file_id, min(p.id) as person_id from f left join p on length(stem) > 0 and ((length(n) > 0 and contains(n, stem)) or (length(first) > 0 and contains(stem, first)) or (length(local) > 0 and local = regexp_replace(stem, '[{BLANKS}]', '', 'g'))) group by file_id""",
    "q14_rolling_counts": f"select count(*) as total, count(*) filter (where ts > timestamp '{EVENTS_NOW}' - interval 7 days) as this_week, count(*) filter (where ts > timestamp '{EVENTS_NOW}' - interval 24 hours) as today from events",
    "q15_newest_per_user": "select user_id, rn, event_id, event_type, total from (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn, count(*) over (partition by user_id) as total from events) where rn <= 10",
    "q15_second_page": "select event_id, user_id, event_type from events order by ts desc, event_id limit 10 offset 10",
    "q16_history_labels": f"""with h as (select *, cast(floor((epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 1000000.0) as bigint) as s from {once('history_entries', '*')} where entry_type = 'upload')
      select id, {AGE.replace('TS', 'created_at')} as age_label, coalesce(nullif(status, ''), 'success') as shown_status from h""",
    "q17_role_shares": f"with n as (select lower({trim('coalesce(nullif(role, ' + chr(39) * 2 + '), ' + chr(39) + 'instructor' + chr(39) + ')')}) as role, count(*) as n from {once('users', '*')} group by 1) select role, n, round(n * 100.0 / sum(n) over (), 1) as percent from n",
    "q18_members_per_section": f"""with st as (select {key('section_id')} as k, count(*) as n from {once('students', '*')} group by 1), x as (select s.id, s.name, cast(coalesce(n, 0) as bigint) as members from {once('sections', '*')} s left join st on st.k = {key('s.id')})
      select *, round(members * 100.0 / greatest(max(members) over (), 1), 1) as share from x""",
    "q19_users_with_counts": f"with a as (select {key('user_id')} as k, count(*) as n from {once('analyses', '*')} group by 1) select u.id, u.username, cast(coalesce(n, 0) as bigint) as total_analyses from {once('users', '*')} u left join a on a.k = {key('u.id')}",
    "q20_nested_sections": "select n_name, coalesce(string_agg(c_name, ',' order by c_name), '') as members from nation left join customer on c_nationkey = n_nationkey group by n_nationkey, n_name",
    "q21_enrolled": f"select c_custkey as k, c_name from customer where c_custkey in {RICH}",
    "q22_not_enrolled": f"select c_custkey as k, c_name from customer where c_custkey not in {RICH}",
    "q23_last_entry_preview": f"""with h as (select *, {key('user_id')} as user_key from {once('history_entries', '*')}), r as (select *, row_number() over (partition by user_key order by created_at desc, id desc) as rn from h where user_key is not null and created_at is not null)
      select user_key, id, case when length(description) > 36 then substring(description, 1, 36) || '...' else description end as preview from r where rn = 1""",
    "q24_contacts": f"select full_name as name, 'user' as role from {once('users', '*')} where length(full_name) > 0 union all select name, 'student' from {once('students', '*')} where length(name) > 0",
    "q25_verdicts": f"""with a as (select id, code, language, {trim('code')} as t from {once('analyses', '*')})
      select id, case when code is null then 'missing code' when language is null then 'missing language' when length(t) = 0 then 'empty code' when length(t) < 4 then 'code too short' when lower({trim('language')}) not in ('python', 'java') then 'unsupported language' end as strict_error,
      case when code is null then 'missing code' when language is null then 'missing language' when length(t) = 0 then 'empty code' when language not in ('python', 'java') then 'unsupported language' end as lenient_error,
      cast(case when code is null or language is null or length(t) < 4 or lower({trim('language')}) not in ('python', 'java') then 400 end as bigint) as error_code from a""",
    "q26_file_listing": f"""select id, name, case when size >= 1048576 then cast(round(size / 1048576.0::double, 1) as varchar) || ' MB' when size >= 1024 then cast(round(size / 1024.0::double, 1) as varchar) || ' KB' else cast(size as varchar) || ' B' end as size_label,
      strftime(created_at, '%b %-d, %Y') as day_label, strftime(created_at, '%B %-d, %Y') as long_day, strftime(created_at, '%b %-d, %I:%M %p') as moment, case when microsecond(created_at) % 1000000 = 0 then strftime(created_at, '%Y-%m-%dT%H:%M:%S') else strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') end as iso,
      case {KIND} when 'zip' then 'ZIP' when 'java' then 'Java' when 'python' then 'Python' when 'text' then 'Text' else 'File' end as kind_label, case {KIND} when 'zip' then 'ZIP' when 'java' then 'JV' when 'python' then 'PY' when 'text' then 'TXT' else 'F' end as icon,
      case lower(string_split(name, '.')[-1]) when 'zip' then 'ZIP' when 'java' then 'Java' when 'py' then 'Python' else 'Text' end as by_name from {once('uploaded_files', '*')}""",
    "q26_file_search": f"select id, name, strftime(created_at, '%Y-%m') as section from {once('uploaded_files', '*')} where contains(lower(coalesce(name, '')), 'lab') and {KIND} = 'java' and strftime(created_at, '%Y-%m') = '2024-03'",
    "q27_html_escape": "select doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as escaped_md5 from documents",
    "q28_token_counts": f"""with a as (select id, coalesce(code, '') as t, lower({trim("coalesce(language, '')")}) as lang from {once('analyses', '*')})
      select id, cast(len(regexp_extract_all(t, '{NUMBER}')) as bigint) as numbers, cast(len(regexp_extract_all(t, '{CALL}')) as bigint) as calls, cast(case when lang = 'python' then {_kw(PYTHON_WORDS)} else {_kw(JAVA_WORDS)} end as bigint) as keywords,
      cast(case when lang = 'python' then {_comments('#')} else {_comments('//')} end as bigint) as comment_lines from a""",
    "q29_insert": "select c_custkey, c_name, c_mktsegment from customer union all select s_suppkey * 40, s_name, 'NEW' from supplier where s_suppkey * 40 not in (select c_custkey from customer) and s_name not in (select c_name from customer)",
    "q29_update": "select c_custkey, case when c_custkey = 7 then 'CHANGED' else c_mktsegment end as c_mktsegment from customer",
    "q29_delete_cascade": "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)",
    "q29_upsert": "with n as (select p_partkey + 10 as p_partkey, 0 as p_size from part where p_size > 40) select p_partkey, p_size from part where p_partkey not in (select p_partkey from n) union all select p_partkey, p_size from n",
    "q30_daily_counts": "select strftime(ts, '%Y-%m-%d') as day, event_type as kind, count(*) as n from events group by all",
    "q31_json_fields": f"select id, cast(case when json_valid(clones_json) and json_type(clones_json) = 'ARRAY' then json_array_length(clones_json) else 0 end as bigint) as elements, cast(case when json_valid(clones_json) then json_extract(clones_json, '$[0].clone_type') end as bigint) as first_type from {once('analyses', '*')}",
    "q33_text_labels": f"""select id, {_BASE} as base, {_STEM} as stem, lower(string_split(coalesce(name, ''), '.')[-1]) as ext, upper(substring({_BASE}, 1, 1)) || substring({_BASE}, 2) as title,
      regexp_replace({_STEM}, '[{BLANKS}]', '', 'g') as tight, url_encode(coalesce(name, '')) as url from {once('uploaded_files', '*')}""",
    "q34_first_lookup": f"select s.id, coalesce(u.username, 'none') as username from {once('students', '*')} s left join (select email, arg_min(username, id) as username from {once('users', '*')} where email is not null group by 1) u on u.email = s.email",
    "q35_owned_row": "select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders where o_orderkey = 7 and o_orderstatus = 'F' union all select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders where o_custkey = 7 and o_orderkey <> 7",
    "q36_grouped_rows": "select coalesce(nullif(c_mktsegment, ''), 'Unassigned') as c_mktsegment, string_agg(cast(c_custkey as varchar), ',' order by c_custkey) as members from customer group by 1",
    "q37_batch_flags": f"""select id, case when clone_percentage > 50 then 'high' else 'medium' end as severity, 'warning' as status, case when clone_percentage > 70 then 'red' when clone_percentage > 40 then 'orange' else 'green' end as badge from {once('analyses', '*')} where clone_percentage > 30""",
    "q38_complete_rows": f"select id from {once('students', '*')} where section_id is not null and submissions is not null and created_at is not null",
    "q39_users_search": f"select id from {once('users', '*')} where contains(lower(coalesce(username, '')), 'mar') or contains(lower(coalesce(email, '')), 'mar') or contains(lower(coalesce(full_name, '')), 'mar')",
    "q40_section_by_id_or_name": f"""with s as {once('sections', 'id, name')}, k as (select name as k from s union select id from s), m as (select k, s.id, s.name, row_number() over (partition by k order by s.id) as rn from k left join s on s.id = k or s.name = k)
      select k, id as matched_id, name as matched_name from m where rn = 1""",
    "q41_renamed_clones": f"""with p as (select id, unnest(string_split(coalesce(code, ''), chr(10))) as line from {once('analyses', '*')}), t as (select id, {trim('line')} as l from p), u as (select * from t where length(l) > 10),
      n as (select id, l, {normalised('l')} as m from u), c as (select id, count(*) - count(distinct m) as clone_lines, count(*) - count(distinct l) as exact_lines from n group by id)
      select a.id, cast(coalesce(clone_lines, 0) as bigint) as clone_lines, cast(coalesce(exact_lines, 0) as bigint) as exact_lines from {once('analyses', 'id')} a left join c on c.id = a.id""",
    "q42_metric_changes": f"""with a as (select id, created_at, clone_percentage as v, {key('user_id')} as k from {once('analyses', '*')}), w as (select id, v, lag(v) over (partition by k order by created_at, id) as previous from a where k is not null and created_at is not null)
      select id, previous, round(v - previous, 4) as change from w""",
    "q43_top_suggestions": f"""with {CODE}, s as (select id, 'Extract Method' as refactoring_type, duplicate_lines from m where clone_percentage > 10 union all select id, 'Simplify Conditionals', duplicate_lines from m where cyclomatic_complexity > 10),
      r as (select id, refactoring_type, rank() over (partition by refactoring_type order by duplicate_lines desc) as impact_rank from s) select * from r where impact_rank <= 20""",
    "q44_file_totals": f"select count(*) as files, cast(coalesce(sum(size), 0) as bigint) as total_size, count(distinct {KIND}) as kinds from {once('uploaded_files', '*')}",
    "q44_member_totals": f"select (select count(*) from {once('sections', 'id')}) as parents, count(*) as children from {once('students', '*')} st join {once('sections', '*')} se on {key('se.id')} = {key('st.section_id')}",
    "q44_overall_mean": f"select cast(coalesce(floor(avg(coalesce(cast(clone_percentage as decimal(18,6)), 0)) + 0.5), 0) as bigint) as mean_clone from {once('analyses', '*')}",
    "q45_gated_users": f"""with u as (select * from {once('users', '*')}), a as (select min(id) as me from u where role = 'admin'), s as (select min(id) as me from u where role = 'student')
      select 'admin' as asked_by, id, username from u, a where id <> me and (select role from u where id = me) in ('admin') union all select 'student', id, username from u, s where id <> me and (select role from u where id = me) in ('admin', 'instructor')""",
    "q46_section_files": f"""with se as (select *, {key('id')} as k from {once('sections', '*')}), taught as (select {key('instructor_id')} as teacher, arg_min(k, id) as group_key from se where {key('instructor_id')} is not null group by 1),
      f as (select id as file_id, lower({_STEM}) as stem, group_key from {once('uploaded_files', '*')} u left join taught on teacher = {key('u.user_id')}),
      p as (select st.id, se.k, lower(coalesce(st.name, '')) as n, split_part(lower(coalesce(st.name, '')), ' ', 1) as first, lower(split_part(coalesce(email, ''), '@', 1)) as local from {once('students', '*')} st join se on se.k = {key('st.section_id')})
      select file_id, group_key, min(p.id) as person_id from f left join p on (group_key is null or group_key = p.k) and length(stem) > 0 and ((length(n) > 0 and contains(n, stem)) or (length(first) > 0 and contains(stem, first)) or (length(local) > 0 and local = regexp_replace(stem, '[{BLANKS}]', '', 'g'))) group by file_id, group_key""",
    "q47_descriptions": f"""with a as (select id, language, regexp_replace(cast(clone_percentage as varchar), '\\.0$', '') as c from {once('analyses', '*')}) select id, 'Analyzed ' || language || ' code - ' || c || '% clone detected' as code,
      'Analyzed ' || language || ' code - ' || c || '% clone detected (mock)' as mock, 'Analyzed ' || language || ' file: ' || substring(id, 1, 8) || ' - ' || c || '% clone detected' as file from a""",
    "q47_batch_descriptions": f"select id, 'Uploaded batch: ' || name || ' - ' || cast(size as varchar) || ' files extracted' || case when {KIND} <> 'zip' and {KIND} <> '' then ' (Section: ' || {KIND} || ')' else '' end as description from {once('uploaded_files', '*')}",
    "q48_hex_colours": f"select id, regexp_matches(substring(id, 1, 6), '^[0-9a-fA-F]{{6}}$') as six, false as seven, regexp_matches({trim('username')}, '^[0-9a-fA-F]{{6}}$') as name from {once('users', '*')}",
    "q49_first_users": f"select id, username from {once('users', '*')} order by id limit 500",
    "q50_owned_delete": f"""with f as (select id, user_id, {KIND} as kind from {once('uploaded_files', '*')}) select id, kind from f
      where not coalesce(kind = 'java' and user_id is not null, false) and not coalesce(kind = 'python' and user_id = (select min(user_id) from f), false)""",
    "q51_prepended": "select c_custkey as key, c_name as name, cast(0 as bigint) as batch from customer union all select s_suppkey, s_name, 1 from supplier",
    "q52_string_literals": f"""with a as (select id, regexp_extract_all(coalesce(code, ''), '{LITERALS}') as found from {once('analyses', '*')}) select id, cast(len(found) as bigint) as literals, md5(array_to_string(found, chr(10))) as literals_md5 from a""",
    "q53_first_lines": f"""with n as (select doc_id, text, least(5, {LINES_OF.replace('TEXT', 'text')}) as n from documents)
      select doc_id, case when length(text) > 0 then md5(array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10))) end as first_md5, left(repeat('# line' || chr(10), cast(n as bigint)), cast(n * 7 - 1 as bigint)) as repeated from n""",
    "q54_member_labels": f"""with st as (select {key('section_id')} as k, count(*) as n from {once('students', '*')} group by 1), x as (select s.id, coalesce(n, 0) as n from {once('sections', '*')} s left join st on st.k = {key('s.id')})
      select id, cast(n as varchar) || case when n = 1 then ' student' else ' students' end as label from x""",
    "q55_default_suggestions": f"with n as (select doc_id, {LINES_OF.replace('TEXT', 'text')} as n from documents) select doc_id, case when n >= 4 then 'Extract Method' end as refactoring_type, cast(case when n >= 4 then 1 end as bigint) as priority from n",
    "q56_json_rows": f"select id, cast(json_object('id', id, 'username', username, 'full_name', full_name, 'role', role) as varchar) as row from {once('users', '*')}",
    "q57_changed_element": "select n_name, coalesce(string_agg(case when c_custkey = 7 then 'CHANGED' else c_name end, ',' order by c_custkey), '') as members from nation left join customer on c_nationkey = n_nationkey group by n_nationkey, n_name",
    "q58_flattened": f"select se.id as section, row_number() over (partition by se.id order by st.id) - 1 as at, st.name, st.email from {once('students', '*')} st join {once('sections', '*')} se on {key('se.id')} = {key('st.section_id')}",
    "p2_found": f"with {P2} select distinct table_name, record_id from states where state <> 'ok'",
    "p2_orphans_by_period": f"""with {P2}, c as (select table_name, strftime(created_at, '%Y-%m') as period, count(*) as refs, count(*) filter (where state = 'missing') as missing, count(*) filter (where state = 'deleted') as deleted, count(*) filter (where state = 'late') as late from states group by all)
      select *, missing + deleted + late as orphans, round((missing + deleted + late) * 100.0 / refs, 2) as orphan_percent from c""",
}

"""DuckDB SQL of the queries that SQL can express on whole tables, stated without the operators' code."""

from __future__ import annotations

RECORDS = """r as (select id, max(text) as text from (select id, code as text from analyses union all select id, content from uploaded_files FILES) where id is not null and regexp_matches(text, '\\S') group by id)"""
EVERY = RECORDS.replace("FILES", "")
CODE = RECORDS.replace("FILES", "where coalesce(lower(trim(file_type, ' \t\n\r')), '') <> 'text'")

# all windows of 200 characters, those that stand in another record too, and the stretches they cover
SPANS = f"""{EVERY}, w as (select id, unnest(range(1, length(text) - 198)) as i, text from r where length(text) >= 200), h as (select id, i, md5_number(substring(text, i, 200)) as h from w),
  twice as (select h from h group by h having min(id) <> max(id)), m as (select distinct id, i from h semi join twice using (h)),
  g as (select *, case when i <= lag(i) over (partition by id order by i) + 200 then 0 else 1 end as new from m), k as (select *, sum(new) over (partition by id order by i) as stretch from g),
  spans as (select id as record_id, min(i) - 1 as span_start, max(i) + 199 - (min(i) - 1) as span_chars from k group by id, stretch)"""

# sets of triples of words, and the pairs of records whose sets are similar or whose words are the same
PAIRS = f"""{CODE}, ws as (select id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from r),
  t as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as t from ws), n as (select id, count(*) as n from t group by id),
  c as (select a.id as id_a, b.id as id_b, count(*) as c from t a join t b on a.t = b.t and a.id < b.id group by all),
  near as (select id_a, id_b from c join n a on a.id = id_a join n b on b.id = id_b where c >= 0.6 * (a.n + b.n - c) - 1e-9),
  pairs as (select * from near union select a.id, b.id from ws a join ws b on a.w = b.w and a.id < b.id)"""

ORACLES: dict[str, str] = {
    "p1_found": f"with {SPANS} select * from spans",
    "p1_shared_part": f"""with {SPANS}, s as (select record_id, count(*) as spans, cast(sum(span_chars) as bigint) as shared_chars from spans group by 1)
      select id as record_id, cast(length(text) as bigint) as chars, coalesce(spans, 0) as spans, coalesce(shared_chars, 0) as shared_chars, round(coalesce(shared_chars, 0) * 100.0 / length(text), 2) as shared_percent from r left join s on id = record_id""",
    "p6_found": f"with {PAIRS} select * from pairs",
    "p6_groups": f"""with recursive {PAIRS}, e as (select id_a as a, id_b as b from pairs union all select id_b, id_a from pairs), reach as (select id, id as other from r union select reach.id, e.b from reach join e on e.a = reach.other),
      grp as (select id, min(other) as group_id from reach group by id), s as (select ws.id, case when len(w) < 3 then 'w ' || list_aggregate(w, 'string_agg', ' ') else (select string_agg(t, '|' order by t) from t where t.id = ws.id) end as s from ws),
      copies as (select s, count(*) as copies from s group by s), linked as (select x.id, count(distinct y.s) as links from e join s x on x.id = e.a join s y on y.id = e.b where x.s <> y.s group by x.id)
      select s.id as record_id, group_id, copies, coalesce(links, 0) as links from s join grp using (id) join copies on copies.s is not distinct from s.s left join linked using (id)""",
}

"""The query catalogue over the driver's tables. Each callable takes (spark, sf_dir) and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions import labels as L
from marquetry.functions import text as X
from marquetry.operators import activity, catalogue, clones, dml, extensions, matching, metrics, references, similarity, validate
from marquetry.sources.files import extension
from marquetry.sources.jsoncols import as_json, exploded
from marquetry.sources.tables import file_bytes, one_per_id, spread, table

#: "Now" of the time-dependent queries.
NOW = "2024-06-01 00:00:00"
EVENTS_NOW = "2024-01-20 12:00:00"


def _now(at: str = NOW):
    return F.lit(at).cast("timestamp_ntz")


def _code(spark: SparkSession, d: str) -> DataFrame:
    """Rows as delivered: measure first, then take one per id, so that no text of a large table is exchanged."""
    a = table(spark, d, "analyses")
    return spread(a.select("id", "language", "code"), "id", file_bytes(a))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """One row per analysis with the metrics of its code."""
    return one_per_id(metrics.document_metrics(_code(spark, d), "code", F.col("language")).drop("code", "language"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """One row per analysis: section (normalised language), member, three measures."""
    df = one_per_id(table(spark, d, "analyses").select("id", "user_id", "language", "clone_percentage", "cyclomatic_complexity", "maintainability_index"))
    return df.select("id", F.lower(X.trimmed(F.col("language"))).alias("section"), references.normal_key(F.col("user_id")).alias("member"), "clone_percentage", "cyclomatic_complexity", "maintainability_index")


def q01_duplicate_lines(spark, d):
    out = metrics.document_metrics(table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", "total_lines", "duplicate_lines", "clone_percentage")


def q02_complexity(spark, d):
    return _measured(spark, d).select("id", "cyclomatic_complexity")


def q03_maintainability(spark, d):
    return _measured(spark, d).select("id", "clone_percentage", "maintainability_index")


def q04_clone_pairs(spark, d):
    return clones.clone_pairs(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def q05_suggestions(spark, d):
    out = metrics.suggestions(_measured(spark, d))
    return out.select("id", "refactoring_type", F.col("priority").cast("bigint").alias("priority"))


def q06_class_histogram(spark, d):
    return metrics.class_histogram(_measured(spark, d))


def q07_line_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.line_count(F.col("text")).cast("bigint").alias("lines_of_code"))


def q08_outline_spans(spark, d):
    lines = table(spark, d, "documents").select("doc_id", X.line_count(F.col("text")).cast("bigint").alias("lines_of_code"))
    return metrics.outline_spans(lines).select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("span_no", "start_line", "end_line")])


def q09_section_summary(spark, d):
    return catalogue.section_summary(_results(spark, d), "section", "member", "clone_percentage")


def q10_section_analytics(spark, d):
    mean = lambda c: F.round(F.avg(F.coalesce(F.col(c).cast("decimal(18,6)"), F.lit(0))), 1).cast("double")
    out = _results(spark, d).groupBy(X.falsy_to(F.col("section"), "Unassigned").alias("section")).agg(
        F.count("*").alias("files"), mean("clone_percentage").alias("avg_clone"), mean("cyclomatic_complexity").alias("avg_complexity"),
        mean("maintainability_index").alias("avg_maintainability"), F.count_if(F.col("clone_percentage") > 30).alias("high_clone_files"),
    )
    return out.withColumn("clone_class", L.klass(F.col("avg_clone"), "section"))


def q11_member_pairs(spark, d):
    return similarity.pair_status_counts(similarity.member_means(_results(spark, d), "section", "member", "clone_percentage"))


def q11_high_pairs(spark, d):
    return similarity.high_pairs(similarity.member_means(_results(spark, d), "section", "member", "clone_percentage"), 40)


def q12_pair_keys(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("c"), "o_orderkey").alias("b"))
    return similarity.first_pairs(df.filter("a <> b"), "a", "b", "o_orderkey").select("pair_key", "o_orderkey")


def q13_file_owner(spark, d):
    files = one_per_id(table(spark, d, "uploaded_files").select("id", "name")).select(F.col("id").alias("file_id"), F.col("name").alias("file_name"), F.lit(None).cast("string").alias("group_key"))
    people = one_per_id(table(spark, d, "students").select("id", "name", "email", "section_id")).select(
        F.col("id").alias("person_id"), "name", "email", F.coalesce("section_id", F.lit("")).alias("group_key"), F.col("id").alias("pos")
    )
    return matching.match_files_to_people(files, people).select("file_id", "person_id")


def q14_rolling_counts(spark, d):
    return activity.rolling_counts(table(spark, d, "events").select("ts"), "ts", _now(EVENTS_NOW))


def q15_newest_per_user(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return activity.page_per_key(ev, "user_id", [F.col("ts").desc(), F.col("event_id")], 10).select("user_id", F.col("rn").cast("bigint").alias("rn"), "event_id", "event_type", "total")


def q15_second_page(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return activity.page(ev, [F.col("ts").desc(), F.col("event_id")], 10, 10).select("event_id", "user_id", "event_type")


def q16_history_labels(spark, d):
    h = one_per_id(table(spark, d, "history_entries").select("id", "entry_type", "status", "created_at"))
    return activity.with_labels(activity.by_type(h, "entry_type", "upload"), "created_at", _now(), "status").select("id", "age_label", "shown_status")


def q17_role_shares(spark, d):
    u = one_per_id(table(spark, d, "users").select("id", "role"))
    return catalogue.shares(u, F.lower(X.trimmed(X.falsy_to(F.col("role"), "instructor"))), "role")


def q18_members_per_section(spark, d):
    st = one_per_id(table(spark, d, "students").select("id", "section_id")).withColumn("section_key", references.normal_key(F.col("section_id")))
    se = one_per_id(table(spark, d, "sections").select("id", "name")).withColumn("key", references.normal_key(F.col("id")))
    out = catalogue.with_child_count(se, st, "key", "section_key", "members")
    return catalogue.share_of_max(out, "members").select("id", "name", "members", "share")


def q19_users_with_counts(spark, d):
    u = one_per_id(table(spark, d, "users").select("id", "username")).withColumn("key", references.normal_key(F.col("id")))
    a = one_per_id(table(spark, d, "analyses").select("id", "user_id")).withColumn("user_key", references.normal_key(F.col("user_id")))
    return catalogue.with_child_count(u, a, "key", "user_key", "total_analyses").select("id", "username", "total_analyses")


def q20_nested_sections(spark, d):
    n, c = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "customer").select("c_nationkey", "c_name")
    out = catalogue.nested_children(n, c, "n_nationkey", "c_nationkey", ["c_name"], "members")
    return out.select("n_name", F.array_join(F.transform("members", lambda m: m["c_name"]), ",").alias("members"))


def q21_enrolled(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return matching.members_of(c, table(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 400000").select(F.col("o_custkey").alias("k")), "k").select("k", "c_name")


def q22_not_enrolled(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return matching.not_members(c, table(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 400000").select(F.col("o_custkey").alias("k")), "k").select("k", "c_name")


def q23_last_entry_preview(spark, d):
    h = one_per_id(table(spark, d, "history_entries").select("id", "user_id", "description", "created_at")).withColumn("user_key", references.normal_key(F.col("user_id"))).filter("user_key is not null and created_at is not null")
    last = h.groupBy("user_key").agg(F.max_by(F.struct("id", "description"), F.struct("created_at", "id")).alias("r"))
    return last.select("user_key", F.col("r.id").alias("id"), X.shortened(F.col("r.description")).alias("preview"))


def q24_contacts(spark, d):
    u = one_per_id(table(spark, d, "users").select("id", "full_name"))
    s = one_per_id(table(spark, d, "students").select("id", "name"))
    return catalogue.contacts((u, "full_name", "user"), (s, "name", "student"))


def q25_verdicts(spark, d):
    return one_per_id(validate.with_verdicts(_code(spark, d), "code", "language").select("id", "strict_error", "lenient_error", F.col("error_code").cast("bigint").alias("error_code")))


def q26_file_listing(spark, d):
    f = _files(spark, d)
    at = F.col("created_at")
    return f.select(
        "id", "name", L.size_label(F.col("size")).alias("size_label"), L.day_label(at).alias("day_label"), L.day_label(at, "long_day").alias("long_day"), L.day_label(at, "moment").alias("moment"), L.iso_label(at).alias("iso"),
        L.kind_label(F.col("kind")).alias("kind_label"), L.kind_icon(F.col("kind")).alias("icon"), L.kind_label(L.file_kind(extension(F.col("name")))).alias("by_name"),
    )


def _files(spark, d):
    f = one_per_id(table(spark, d, "uploaded_files").select("id", "name", "size", "file_type", "created_at"))
    return f.withColumn("kind", F.lower(X.trimmed(F.col("file_type")))).withColumn("section", F.date_format("created_at", "yyyy-MM"))


def q26_file_search(spark, d):
    """The three conditions of the file list at once; months stand for sections."""
    return catalogue.filter_files(_files(spark, d), "LAB", "java", "2024-03").select("id", "name", "section")


def q27_html_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.html_escaped(F.col("text"))).alias("escaped_md5"))


def q28_token_counts(spark, d):
    return one_per_id(metrics.token_counts(_code(spark, d), "code", F.col("language")).select("id", "numbers", "calls", "keywords", "comment_lines"))


def q29_insert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = table(spark, d, "supplier").select((F.col("s_suppkey") * 40).alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return dml.guarded_append(old, new, ["c_custkey", "c_name"])


def q29_update(spark, d):
    return dml.update(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == 7, c_mktsegment=F.lit("CHANGED"))


def q29_delete_cascade(spark, d):
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey")
    return dml.cascade(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone)


def q29_upsert(spark, d):
    old = table(spark, d, "part").select("p_partkey", "p_size")
    new = table(spark, d, "part").filter("p_size > 40").select((F.col("p_partkey") + 10).alias("p_partkey"), F.lit(0).alias("p_size"))
    return dml.upsert(old, new, "p_partkey")


def q30_daily_counts(spark, d):
    from marquetry.streaming.feed import daily_counts

    return daily_counts(table(spark, d, "events").select("ts", "event_type"), "ts", "event_type").select(F.col("day").cast("string").alias("day"), "kind", "n")


def q31_json_fields(spark, d):
    from marquetry.sources.jsoncols import parsed

    a = one_per_id(table(spark, d, "analyses").select("id", "clones_json"))
    clones_ = parsed(F.col("clones_json"), "clones")
    return a.select("id", F.size(clones_).cast("bigint").alias("elements"), F.get(clones_, F.lit(0))["clone_type"].cast("bigint").alias("first_type"))


def q32_simple_syntax(spark, d):
    return one_per_id(_code(spark, d).select("id", validate.simple_syntax(F.col("code"), F.col("language")).alias("parses")))


def q33_text_labels(spark, d):
    f = one_per_id(table(spark, d, "uploaded_files").select("id", "name"))
    n = F.coalesce("name", F.lit(""))
    return f.select(
        "id", X.base_name(n).alias("base"), X.stem_words(n).alias("stem"), extension(n).alias("ext"),
        X.capitalised(X.base_name(n)).alias("title"), X.without_blanks(X.stem_words(n)).alias("tight"), X.url_component(n).alias("url"),
    )


def q34_first_lookup(spark, d):
    st = one_per_id(table(spark, d, "students").select("id", "email"))
    us = one_per_id(table(spark, d, "users").select("id", "email", "username"))
    return matching.first_lookup(st, us, "email", "id").select("id", F.coalesce("m_username", F.lit("none")).alias("username"))


def q35_owned_row(spark, d):
    return catalogue.by_key(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), 7, "o_orderkey", o_orderstatus="F").unionByName(
        catalogue.taken_by_others(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), "o_custkey", 7, "o_orderkey", 7)
    )


def q36_grouped_rows(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey")
    return catalogue.grouped_rows(c, "c_mktsegment", ["c_custkey"]).select("c_mktsegment", F.array_join(F.transform("rows", lambda r: r["c_custkey"].cast("string")), ",").alias("members"))


def q37_batch_flags(spark, d):
    a = one_per_id(table(spark, d, "analyses").select("id", "clone_percentage"))
    flags = a.withColumn("severity", L.batch_flag(F.col("clone_percentage"))).filter("severity is not null")
    return flags.select("id", "severity", L.klass(F.col("clone_percentage"), "history").alias("status"), L.klass(F.col("clone_percentage"), "badge").alias("badge"))


def q38_complete_rows(spark, d):
    return catalogue.complete(one_per_id(table(spark, d, "students").select("id", "section_id", "submissions", "created_at")), "section_id", "submissions", "created_at").select("id")


def q39_users_search(spark, d):
    return catalogue.search(one_per_id(table(spark, d, "users").select("id", "username", "email", "full_name")), "Mar", ["username", "email", "full_name"]).select("id")


def q40_section_by_id_or_name(spark, d):
    sec = one_per_id(table(spark, d, "sections").select("id", "name"))
    left = sec.select(F.col("name").alias("k")).unionByName(sec.select(F.col("id").alias("k"))).distinct()
    return matching.lookup_by_id_or_name(left, "k", sec.withColumn("pos", F.col("id")), "pos").select("k", "matched_id", "matched_name")


def q41_renamed_clones(spark, d):
    return one_per_id(extensions.renamed_clones(_code(spark, d), "id", "code"))


def q42_metric_changes(spark, d):
    a = one_per_id(table(spark, d, "analyses").select("id", "user_id", "created_at", "clone_percentage")).withColumn("user_key", references.normal_key(F.col("user_id"))).filter("user_key is not null and created_at is not null")
    return extensions.changes(a, "user_key", ["created_at", "id"], "clone_percentage").select("id", "previous", "change")


def q43_top_suggestions(spark, d):
    s = metrics.suggestions(_measured(spark, d))
    return extensions.ranked_by_impact(s, "duplicate_lines", 20).select("id", "refactoring_type", F.col("impact_rank").cast("bigint").alias("impact_rank"))


def q44_file_totals(spark, d):
    return catalogue.totals(_files(spark, d), "size", "kind")


def q44_member_totals(spark, d):
    return catalogue.total_children(_sections(spark, d), "students")


def q44_overall_mean(spark, d):
    return catalogue.overall_mean(_results(spark, d), "clone_percentage", "mean_clone")


def _sections(spark, d):
    """Sections by normalised key, with their students nested."""
    se = one_per_id(table(spark, d, "sections").select("id", "name", "instructor_id")).withColumn("key", references.normal_key(F.col("id")))
    st = one_per_id(table(spark, d, "students").select("id", "name", "email", "section_id")).withColumn("section_key", references.normal_key(F.col("section_id")))
    return catalogue.nested_children(se, st, "key", "section_key", ["id", "name", "email"], "students")


def _users(spark, d):
    return one_per_id(table(spark, d, "users").select("id", "username", "role"))


def _first_user(spark, d, role: str):
    return _users(spark, d).filter(F.col("role") == role).agg(F.min("id")).scalar()


def q45_gated_users(spark, d):
    """What the first admin and the first student get to see: all users but themselves, and nothing."""
    u = _users(spark, d)
    seen = lambda role, roles: catalogue.allowed(catalogue.others(u, "id", _first_user(spark, d, role)), u, _first_user(spark, d, role), roles).select(F.lit(role).alias("asked_by"), "id", "username")
    return seen("admin", ("admin",)).unionByName(seen("student", ("admin", "instructor")))


def q46_section_files(spark, d):
    """Files matched to the people of the section that the uploader teaches (the first by id), and to all people where there is none."""
    s = _sections(spark, d)
    p = matching.section_people(s.select("key", "students")).select(F.col("id").alias("person_id"), "name", "email", F.col("key").alias("group_key"), F.col("id").alias("pos"))
    taught = s.select(references.normal_key(F.col("instructor_id")).alias("teacher"), "id", "key").filter("teacher is not null").groupBy("teacher").agg(F.min_by("key", "id").alias("group_key"))
    f = one_per_id(table(spark, d, "uploaded_files").select("id", "name", "user_id")).withColumn("teacher", references.normal_key(F.col("user_id")))
    f = f.join(taught, "teacher", "left").select(F.col("id").alias("file_id"), F.col("name").alias("file_name"), "group_key")
    return matching.match_files_to_people(f, p).select("file_id", "group_key", "person_id")


def q47_descriptions(spark, d):
    a = one_per_id(table(spark, d, "analyses").select("id", "language", "clone_percentage"))
    percent = X.number_text(F.col("clone_percentage"))
    return a.select("id", activity.described("code", F.col("language"), percent).alias("code"), activity.described("mock", F.col("language"), percent).alias("mock"), activity.described("file", F.col("language"), F.substring("id", 1, 8), percent).alias("file"))


def q47_batch_descriptions(spark, d):
    f = one_per_id(table(spark, d, "uploaded_files").select("id", "name", "size", "file_type"))
    return f.select("id", activity.described("batch", F.col("name"), F.col("size").cast("string"), activity.in_section(F.nullif(F.lower(X.trimmed(F.col("file_type"))), F.lit("zip")))).alias("description"))


def q48_hex_colours(spark, d):
    u = one_per_id(table(spark, d, "users").select("id", "username"))
    return u.select("id", X.is_hex_colour(F.concat(F.lit(" #"), F.substring("id", 1, 6))).alias("six"), X.is_hex_colour(F.concat(F.lit("#"), F.substring("id", 1, 7))).alias("seven"), X.is_hex_colour(F.concat(F.lit("#"), "username")).alias("name"))


def q49_first_users(spark, d):
    return catalogue.first_by(_users(spark, d), "id").select("id", "username")


def q50_owned_delete(spark, d):
    """Requests for all Java files by their owners, and for all Python files by the first owner alone."""
    f = one_per_id(table(spark, d, "uploaded_files").select("id", "user_id", "file_type")).withColumn("kind", F.lower(X.trimmed(F.col("file_type"))))
    asked = f.filter("kind = 'java'").select("id", "user_id").unionByName(f.filter("kind = 'python'").select("id", f.agg(F.min("user_id")).scalar().alias("user_id")))
    return dml.delete_owned(f, asked, "id", "user_id").select("id", "kind")


def q51_prepended(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return dml.prepend(old, new, "batch", 1).select("key", "name", F.col("batch").cast("bigint").alias("batch"))


def q52_string_literals(spark, d):
    found = metrics.string_literals(F.coalesce("code", F.lit("")))
    return one_per_id(_code(spark, d).select("id", F.size(found).cast("bigint").alias("literals"), F.md5(F.array_join(found, "\n")).alias("literals_md5")))


def q53_first_lines(spark, d):
    lines = X.line_count(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.first_lines(F.col("text"))).alias("first_md5"), X.repeated_lines(F.lit("# line"), lines).alias("repeated"))


def q54_member_labels(spark, d):
    s = _sections(spark, d).select("id", F.size("students").alias("n"))
    return s.select("id", F.concat(F.col("n").cast("string"), F.lit(" student"), X.plural(F.col("n"))).alias("label"))


def q55_default_suggestions(spark, d):
    lines = table(spark, d, "documents").select("doc_id", X.line_count(F.col("text")).alias("lines_of_code"))
    return metrics.default_suggestion(lines).select("doc_id", "refactoring_type", F.col("priority").cast("bigint").alias("priority"))


def q56_json_rows(spark, d):
    return one_per_id(table(spark, d, "users").select("id", "username", "full_name", "role")).select("id", as_json("id", "username", "full_name", "role").alias("row"))


def q57_changed_element(spark, d):
    """One customer's name changed inside the nested lists of all nations."""
    n, c = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    out = catalogue.nested_children(n, c, "n_nationkey", "c_nationkey", ["c_custkey", "c_name"], "members")
    changed = dml.update_in_array("members", lambda m: m["c_custkey"] == 7, lambda m: m.withField("c_name", F.lit("CHANGED")))
    return out.select("n_name", F.array_join(F.transform(changed, lambda m: m["c_name"]), ",").alias("members"))


def q58_flattened(spark, d):
    """Sections with their students as JSON text and back: one row per student and place in the list."""
    s = _sections(spark, d).select("id", F.to_json(F.struct(F.array(F.struct("id", "name", F.col("instructor_id").alias("instructor"), "students")).alias("a"))).alias("j"))
    rows = exploded(s.select(F.col("id").alias("section"), F.get_json_object("j", "$.a").alias("sections")), "sections", "saved_sections")
    return rows.select("section", F.posexplode("item_students").alias("at", "m")).select("section", F.col("at").cast("bigint").alias("at"), F.col("m.name").alias("name"), F.col("m.email").alias("email"))


def p2_states(spark: SparkSession, d: str) -> DataFrame:
    """State of every reference of analyses, students and sections (see references.reference_states)."""
    t = lambda n: table(spark, d, n)
    removals = t("removals")
    users = references.parent_intervals(t("users"), removals, "users")
    sections = references.parent_intervals(t("sections"), removals, "sections")

    def refs(name: str, column: str) -> DataFrame:
        rows = t(name).select(F.col("id").alias("record_id"), F.col(column).alias("ref"), "created_at")
        # repeated deliveries are equal in all columns, so one row per id may be any of them
        return rows.groupBy("record_id", "ref", "created_at").agg(F.lit(name).alias("table_name")).select("table_name", "record_id", "ref", "created_at")

    to_users = refs("analyses", "user_id").unionByName(refs("sections", "instructor_id"))
    return references.reference_states(to_users, users).unionByName(references.reference_states(refs("students", "section_id"), sections))


def p2_found(spark, d):
    return p2_states(spark, d).filter("state in ('missing', 'deleted', 'late')").select("table_name", "record_id").distinct()


def p2_orphans_by_period(spark, d):
    return references.orphans_by_period(p2_states(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k[0] in "qp" and k[1:2].isdigit() and callable(f) and k != "p2_states"}

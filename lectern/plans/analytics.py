"""Call logs, rankings, bundles, health, rules and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import bundles, catalog, health, measures, rules, sessions, versions
from lectern.functions.text import sql_key
from lectern.operators.texts import LINK
from lectern.plans.catalog import NOTES, resolution_sql
from lectern.sources.tables import read_table, shared_folder
from lectern.streaming import links as stream


def _calls(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "events").select(
        F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("tool"), F.col("props").alias("argument"), "value"
    )


def _items(spark: SparkSession, directory: str) -> DataFrame:
    return bundles.latest_items(read_table(spark, directory, "context_item"))


def _catalog(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.current_catalog(read_table(spark, directory, "vault_note"))


RULES = {"error": "tool = 'error'", "large": "value > 50", "unvalued": "value is null", "odd": "id % 2 = 1"}


def call_labels(spark: SparkSession, directory: str) -> DataFrame:
    return sessions.labelled(_calls(spark, directory), RULES)


def retrieval_quality(spark: SparkSession, directory: str) -> DataFrame:
    """Calls as queries: their items by score, relevant where a section scores above 60."""
    items = _items(spark, directory).filter("score is not null")
    place = F.row_number().over(bundles.Window.partitionBy("call_id").orderBy(F.desc("score"), "item_id"))
    ranked = items.select(F.col("call_id").alias("query_id"), place.alias("place"), (F.coalesce(F.col("kind") == "section", F.lit(False)) & (F.col("score") > 60)).alias("relevant"))
    return measures.ranking_quality(ranked).select("query_id", *(F.round(c, 9).alias(c) for c in ("ndcg", "recall", "reciprocal")))


def _sections(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "section_slice").filter("section_id is not null").groupBy("section_id").agg(F.max("content").alias("content"))


def similar_sections(spark: SparkSession, directory: str) -> DataFrame:
    return bundles.similar_texts(_sections(spark, directory), "section_id", "content").withColumn("similarity", F.round("similarity", 9))


def section_classes(spark: SparkSession, directory: str) -> DataFrame:
    """The members of the classes that similar_sections names."""
    return bundles.shingle_classes(_sections(spark, directory), "section_id", "content")


def note_findings(spark: SparkSession, directory: str) -> DataFrame:
    found = health.findings(_catalog(spark, directory), F.lit("2026-01-01").cast("timestamp"))
    return found.withColumn("missing", F.array_join("missing", ","))


def _contents(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "note_content").filter("content_id is not null").groupBy("content_id").agg(F.max("content").alias("content"))


def character_findings(spark: SparkSession, directory: str) -> DataFrame:
    return rules.character_findings(_contents(spark, directory), "content_id", "content", rules.character_rules(read_table(spark, directory, "char_def")))


def fixed_contents(spark: SparkSession, directory: str) -> DataFrame:
    known = rules.character_rules(read_table(spark, directory, "char_def"))
    text = rules.without_emoji(rules.fixed(F.col("content"), known))
    return _contents(spark, directory).filter("content is not null").select("content_id", F.sha2(text, 256).alias("digest"), (text != F.col("content")).alias("changed"))


PHRASES = ["in the end", "late at night", "of which", "zum schluss", "tôt le matin"]


def phrase_findings(spark: SparkSession, directory: str) -> DataFrame:
    return rules.phrase_findings(read_table(spark, directory, "documents").select("doc_id", "text"), "doc_id", "text", PHRASES)


def _versions(spark: SparkSession, directory: str) -> DataFrame:
    rows = read_table(spark, directory, "vault_note").filter("note_id is not null and version is not null")
    return rows.groupBy(F.col("note_id").alias("key"), "version").agg(F.max(F.struct("arrived_at", "deleted_at", "path", "title", "updated")).alias("x")).select("key", "version", "x.*").withColumn("revision", versions.revision("path", "title", "updated"))


def _changes(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Newest versions up to the middle of 2025, and the last change of each note since; every fifth expects a stale revision."""
    all_ = _versions(spark, directory)
    then = F.lit("2025-07-01").cast("timestamp")
    newest = lambda rows: rows.groupBy("key").agg(F.max_by(F.struct("revision", "deleted_at", "version"), "version").alias("x")).select("key", "x.*")
    current = newest(all_.filter(F.col("arrived_at") < then))
    later = newest(all_.filter(F.col("arrived_at") >= then)).join(current.select("key", F.col("revision").alias("was")), "key", "left")
    action = F.when(F.col("deleted_at").isNotNull(), "delete").when(F.col("version") == 1, "create").otherwise("update")
    expected = F.when(F.col("key") % 5 == 0, F.lit("stale")).otherwise(F.col("was"))
    return current, later.select("key", action.alias("action"), expected.alias("expected"), "revision")


def merged_versions(spark: SparkSession, directory: str) -> DataFrame:
    return versions.merged(*_changes(spark, directory))


def rewritten_links(spark: SparkSession, directory: str) -> DataFrame:
    """Documents, sections and single links that name current notes, all of which move to `moved/`."""
    notes = _catalog(spark, directory)
    moves = notes.filter("path is not null").select(F.col("path").alias("old")).distinct().withColumn("new", F.concat(F.lit("moved/"), "old"))
    texts = read_table(spark, directory, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    texts = texts.unionByName(_sections(spark, directory).select(F.concat(F.lit("s"), "section_id").alias("id"), F.col("content").alias("text")))
    single = read_table(spark, directory, "extracted_wikilink").select("ref_id", "target", "embed").distinct()
    texts = texts.unionByName(single.select(F.concat(F.lit("l"), "ref_id").alias("id"), F.concat(F.when(F.col("embed"), "!").otherwise(""), F.lit("[["), "target", F.lit("|said]] here")).alias("text")))
    found = versions.rewritten(texts, "id", "text", moves, catalog.note_keys(notes))
    return found.select("id", "rewritten", F.sha2("content", 256).alias("digest"))


def streamed_links(spark: SparkSession, directory: str) -> DataFrame:
    return stream.drained(stream.daily_counts(stream.table_stream(spark, directory, "extracted_wikilink")), shared_folder(spark))


QUERIES = {
    "call_chains": lambda s, d: sessions.chains(_calls(s, d), "view", "click"),
    "call_retries": lambda s, d: sessions.retries(_calls(s, d), "view"),
    "call_labels": call_labels,
    "busiest_sessions": lambda s, d: sessions.busiest(_calls(s, d)),
    "replay_set": lambda s, d: sessions.replay_set(_calls(s, d), "view", "purchase"),
    "usual_followers": lambda s, d: sessions.usual_followers(_calls(s, d)),
    "value_ranks": lambda s, d: measures.nearest_rank(_calls(s, d), "tool", "value", [0.5, 0.95]),
    "score_card": lambda s, d: measures.score_card(_items(s, d), "kind", "score"),
    "retrieval_quality": retrieval_quality,
    "filled_bundles": lambda s, d: bundles.filled(_items(s, d)),
    "bundle_quality": lambda s, d: bundles.bundle_quality(_items(s, d)),
    "similar_sections": similar_sections,
    "section_classes": section_classes,
    "note_findings": note_findings,
    "health_counts": lambda s, d: health.counts(health.findings(_catalog(s, d), F.lit("2026-01-01").cast("timestamp"))),
    "character_findings": character_findings,
    "fixed_contents": fixed_contents,
    "phrase_findings": phrase_findings,
    "change_outcomes": lambda s, d: versions.judged(*_changes(s, d)),
    "merged_versions": merged_versions,
    "version_history": lambda s, d: versions.history(_versions(s, d), "key", "arrived_at", 2).select("key", "version", "place"),
    "rewritten_links": rewritten_links,
    "streamed_links": streamed_links,
}

_CALLS = "calls as (select user_id as session, ts as moment, event_id as id, event_type as tool, props as argument, value from events)"
ITEMS = "items as (select item_id, unnest(max({'call_id': call_id, 'path': path, 'kind': kind, 'section_id': section_id, 'score': score, 'tokens': tokens, 'lifecycle': lifecycle})) from context_item where item_id is not null and call_id is not null group by item_id)"
SECTIONS = "sections as (select section_id, max(content) as content from section_slice where section_id is not null group by section_id)"
_VERSIONS = """versions as (select note_id as key, version, max({'a': arrived_at, 'd': deleted_at, 'p': path, 't': title, 'u': updated}) as x from vault_note where note_id is not null and version is not null group by all),
    revised as (select key, version, x.a as arrived_at, x.d as deleted_at, sha256(concat_ws('|', x.p, x.t, x.u)) as revision from versions),
    current as (select distinct on (key) * from revised where arrived_at < '2025-07-01' order by key, version desc),
    later as (select distinct on (key) * from revised where arrived_at >= '2025-07-01' order by key, version desc),
    changes as (select l.key, case when l.deleted_at is not null then 'delete' when l.version = 1 then 'create' else 'update' end as action,
        case when l.key % 5 = 0 then 'stale' else c.revision end as expected, l.revision, c.revision as was from later l left join current c using (key)),
    judged as (select key, action, revision, case when action = 'create' then case when was is not null then 'exists' else 'applied' end when was is null then 'not_found'
        when expected is not null and expected <> was then 'hash_mismatch' else 'applied' end as status from changes)"""
_EMPTY = lambda f: f"case when coalesce(trim({f}), '') = '' then '{f}' end"
_FOUND = f"""with {NOTES}, found as (select note_id, path,
    coalesce(array_to_string([{_EMPTY("title")}, {_EMPTY("category")}, case when coalesce(len(tags), 0) = 0 then 'tags' end, {_EMPTY("summary")}, {_EMPTY("created")}, {_EMPTY("updated")}], ','), '') as missing,
    coalesce(length(summary), 0) > 200 as long_summary, greatest(floor((epoch(timestamp '2026-01-01') - epoch(try_cast(replace(trim(updated), 'Z', '') as timestamp))) / 86400), 0)::bigint as stale_days,
    starts_with(path, '_raw/') or regexp_matches(lower(path), '(^|/)index(\\.md)?$') as operational from catalog)"""
_DEFS = "defs as (select char, max_by(replacement, {'s': source, 'r': coalesce(replacement, '')}) as replacement from char_def where length(char) = 1 group by char)"

SQL = {
    "call_chains": f"with {_CALLS}, f as (select session, id, tool, moment, lead(tool) over w as nxt, lead(id) over w as next_id, lead(moment) over w as at2 from calls window w as (partition by session order by moment, id)) select session, id, next_id, (floor(epoch(at2))::bigint - floor(epoch(moment))::bigint) as seconds from f where tool = 'view' and nxt = 'click'",
    "call_retries": f"""with {_CALLS}, t as (select *, list_distinct(list_filter(regexp_split_to_array(lower(argument), '[^a-z0-9]+'), lambda x: x <> '')) as tokens from calls),
        b as (select *, list({{'tool': tool, 'tokens': tokens}}) over (partition by session order by moment, id rows between 3 preceding and 1 preceding) as prior from t)
        select session, id from b where tool = 'view' and len(tokens) > 0 and len(list_filter(prior, lambda x: x.tool = 'view' and len(x.tokens) > 0 and len(list_intersect(x.tokens, tokens)) >= 0.5 * least(len(x.tokens), len(tokens)))) > 0""",
    "call_labels": f"with {_CALLS} " + " union all ".join(f"select '{k}' as label, tool, count(*) as calls from calls where {v} group by tool" for k, v in RULES.items()),
    "busiest_sessions": f"with {_CALLS} select session, count(*) as calls, count(distinct tool) as tools from calls group by session order by calls desc, session limit 10",
    "replay_set": f"""with {_CALLS}, f as (select *, lead(tool) over w as nxt, lead(argument) over w as answer from calls window w as (partition by session order by moment, id)), v as (select * from f where tool = 'view'),
        a as (select argument, answer, min(id) as first_id from v where nxt = 'purchase' group by all)
        select * from a union all select argument, null, min(id) from v where argument not in (select argument from a) group by argument""",
    "usual_followers": f"""with {_CALLS}, f as (select session, tool, lead(tool) over (partition by session order by moment, id) as follower from calls), c as (select session, tool, follower, count(*) as times from f where follower is not null group by all)
        select * from c qualify row_number() over (partition by session, tool order by times desc, follower) = 1""",
    "value_ranks": f"with {_CALLS} select tool, 0.5::double as share, quantile_disc(value, 0.5) as value from calls where value is not null group by tool union all select tool, 0.95::double, quantile_disc(value, 0.95) from calls where value is not null group by tool",
    "score_card": f"with {ITEMS} select kind, count(score) as rows, avg(score) as mean, median(score) as median, min(score) as least, max(score) as most from items group by kind",
    "retrieval_quality": f"""with {ITEMS}, r as (select call_id as query_id, row_number() over (partition by call_id order by score desc, item_id) as place, coalesce(kind = 'section', false) and score > 60 as relevant from items where score is not null),
        b as (select query_id, sum(case when relevant and place <= 10 then 1 / log2(place + 1) else 0 end) as dcg, count(*) filter (where relevant) as n, count(*) filter (where relevant and place <= 10) as found, min(case when relevant then place end) as first from r group by query_id)
        select query_id, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 9) as ndcg, round(found / n, 9) as recall, round(1 / first, 9) as reciprocal from b where n > 0""",
    "filled_bundles": f"""with recursive {ITEMS}, o as (select call_id, item_id, tokens, row_number() over (partition by call_id order by coalesce((kind = 'neighbor-note')::int, 0), score / tokens desc nulls last, score desc nulls last, path nulls first, item_id) as place from items where tokens between 1 and 4000),
        f as (select call_id, 0::bigint as place, 0::bigint as item_id, 0 as tokens, 0::bigint as used, false as kept from (select distinct call_id from o)
          union all select o.call_id, o.place, o.item_id, o.tokens, case when f.used + o.tokens <= 4000 then f.used + o.tokens else f.used end, f.used + o.tokens <= 4000 from f join o on o.call_id = f.call_id and o.place = f.place + 1)
        select call_id, item_id, tokens, used from f where kept""",
    "bundle_quality": f"""with {ITEMS}, b as (select call_id, count(*) as items, sum(greatest(coalesce(tokens, 0), 0))::bigint as tokens, sum(case when kind = 'body' then greatest(coalesce(tokens, 0), 0) else 0 end)::bigint as body_tokens from items group by call_id)
        select *, tokens / 4000 as fill, case when tokens > 0 then body_tokens / tokens else 0 end as depth from b""",
    "similar_sections": f"""with {SECTIONS}, w as (select section_id, regexp_extract_all(lower(content), '[a-z0-9]+') as w from sections where content is not null),
        s as (select section_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from w where len(w) > 0),
        c as (select min(section_id) as id, s, len(s) as n from s group by s), m as (select id, n, unnest(s) as g from c),
        j as (select a.id as one, b.id as other, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) as similarity from m a join m b on a.g = b.g and a.id < b.id group by a.id, b.id)
        select one, other, round(similarity, 9) as similarity from j where similarity >= 0.8""",
    "section_classes": f"""with {SECTIONS}, w as (select section_id, regexp_extract_all(lower(content), '[a-z0-9]+') as w from sections where content is not null),
        s as (select section_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from w where len(w) > 0)
        select section_id, min(section_id) over (partition by s) as class from s""",
    "note_findings": _FOUND + " select * from found",
    "health_counts": _FOUND + " select count(*) as notes, count(*) filter (where missing <> '') as incomplete, count(*) filter (where stale_days > 90) as stale, count(*) filter (where stale_days is null) as undated, count(*) filter (where long_summary) as long_summaries, count(*) filter (where operational) as operational from found",
    "character_findings": f"""with {_DEFS}, c as (select content_id, max(content) as content from note_content where content_id is not null group by content_id),
        l as (select content_id, unnest(string_split(content, '')) as char from c) select content_id, char, count(*) as times from l where char in (select char from defs) group by all""",
    "change_outcomes": f"with {_VERSIONS} select key, action, status from judged",
    "merged_versions": f"with {_VERSIONS} select key, revision from current where key not in (select key from judged where status = 'applied') union all select key, revision from judged where status = 'applied' and action <> 'delete'",
    "version_history": f"with {_VERSIONS}, p as (select key, version, row_number() over (partition by key order by arrived_at desc nulls last, version desc) as place from revised) select * from p where place <= 2",
    "rewritten_links": f"""with {resolution_sql("select id, text, unnest(regexp_extract_all(text, $$" + LINK + "$$, 2)) as target from texts").replace("notes as (", f"{SECTIONS}, texts as (select 'd' || doc_id as id, text from documents union all select 's' || section_id, content from sections union all select distinct 'l' || ref_id, case when embed then '!' else '' end || '[[' || target || '|said]] here' from extracted_wikilink), notes as (", 1)},
        aimed as (select target, path, {sql_key("split_part(target, '#', 1)")} as k, regexp_replace(replace('moved/' || path, chr(92), '/'), '(?i)\\.md$', '') as bare from resolved where path is not null),
        renamed as (select target, case when contains(k, '/') then bare else split_part(bare, '/', -1) end || rtrim(substr(target, length(split_part(target, '#', 1)) + 1)) as target2 from aimed where split_part(k, '/', -1) = split_part({sql_key("path")}, '/', -1)),
        m as (select id, map_from_entries(list(distinct {{'k': target, 'v': target2}})) as m from once join renamed using (target) group by id),
        cut as (select id, m, regexp_split_to_array(text, $${LINK}$$) as p, regexp_extract_all(text, $${LINK}$$, 0) as w, regexp_extract_all(text, $${LINK}$$, 1) as b, regexp_extract_all(text, $${LINK}$$, 2) as t, regexp_extract_all(text, $${LINK}$$, 3) as l from texts join m using (id))
        select id, len(list_filter(t, lambda x: m[x] is not null)) as rewritten,
            sha256(array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(case when m[t[i]] is null then w[i] else b[i] || '[[' || m[t[i]] || l[i] || ']]' end, '')), '')) as digest from cut""",
    "streamed_links": "select date_trunc('day', seen_at) as day, count(*) as links, count(*) filter (where embed) as embeds from (select distinct ref_id, seen_at, embed from extracted_wikilink) group by 1",
}

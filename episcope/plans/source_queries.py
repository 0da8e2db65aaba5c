"""Queries on sources, sinks, packing and digests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.operators import digests as H
from episcope.operators import lineage as L
from episcope.operators import packing as Q
from episcope.operators.expectations import run_suite
from episcope.plans.episode_queries import FINDINGS_SQL, findings
from episcope.functions.columns import rounded
from episcope.plans.registry import query
from episcope.plans.views import UNITS_PER_SECOND, Tables
from episcope.session import scratch_folder
from episcope.sources import readers as S
from episcope.sources import sinks as W
from episcope.sources import store

DATA_CAP = 4_000
SEGMENT_CAP = 3_000


def _scratch(t: Tables, what: str) -> str:
    return f"{scratch_folder(t.spark)}/{t.spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


# ---- reading -------------------------------------------------------------------------------------


@query("A1", "v_episodes", "select episode_index, episode_id, length, dataset_from_index, dataset_to_index from v_episodes")
def read_episodes(t: Tables) -> DataFrame:
    columns = ["episode_index", "episode_id", "length", "dataset_from_index", "dataset_to_index"]
    t.episode_meta  # noqa: B018  writes the shards
    return S.read_episodes(t.spark, t.path("episode_meta"), columns)


@query("A2", "", """select 0 as ordinal, 'not_null' as type, 'event_id' as col, true as success, 0::bigint as unexpected_count union all select 1, 'of_type', 'event_id', true, null
union all select 2, 'not_null', 'user_id', count_if(user_id is null) = 0, count_if(user_id is null) from events union all select 3, 'of_type', 'user_id', true, null""")
def read_frames(t: Tables) -> DataFrame:
    rows = S.read_frames(t.spark, f"{t.sf_dir}/events.parquet", ["event_id", "user_id"])
    out = run_suite(rows, S.identity_guard(["event_id", "user_id"]))
    return out.select("ordinal", "type", F.get_json_object("kwargs", "$.column").alias("col"), "success", "unexpected_count")


@query("A3", "", "select event_id, 'k' as name, cast(json_extract(props, '$.k') as bigint) as value from events")
def read_meta_json(t: Tables) -> DataFrame:
    return S.json_entries(t.table("events").select("event_id", "props"), "props")


@query("A3 files", "v_episodes", "select episode_index, episode_id, length, task from v_episodes")
def read_json_files(t: Tables) -> DataFrame:
    """Episode lists as files of one JSON object per line, read back with their schema."""
    path = _scratch(t, "episode-lines")
    t.episodes.select("episode_index", "episode_id", "length", "task").write.json(path)
    return S.read_json_lines(t.spark, path, "episode_index long, episode_id string, length long, task string")


_DOC_METRICS = ("min", "max", "mean", "std", "q01", "q10", "q50", "q90", "q99", "count")


@query("A3 documents", "v_stat_arrays", "select label, feature, metric, position, round(number, 6) + 0.0 as number from ("
       + " union all ".join(f"select label, feature_group as feature, '{m}' as metric, cast(unnest(range(len({m}))) as varchar) as position, unnest({m}) as number from v_stat_arrays" for m in _DOC_METRICS)
       + " union all select label, feature_group, 'image', concat(i, '/0/', i % 2), length + i from v_stat_arrays, (select unnest(range(3)) as i)"
       + " union all select label, feature_group, 'length', '', length from v_stat_arrays)")
def read_statistics_documents(t: Tables) -> DataFrame:
    """Statistics documents, one file per label, whose features, metrics and nesting the reader does not know."""
    path = _scratch(t, "documents")
    # Nested as stored image statistics are: some arrays are one level deeper than others.
    image = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array(F.when(i % 2 == 0, F.array(F.col("length") + i)).otherwise(F.array(F.lit(None), F.col("length") + i))))
    metrics = F.struct(*_DOC_METRICS, image.alias("image"), "length")
    by_label = t.stat_arrays.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("feature_group", metrics))).alias("doc"))
    by_label.select("label", F.to_json("doc").alias("text")).repartition("label").write.partitionBy("label").text(path)
    documents = S.read_documents(t.spark, path)
    label = F.regexp_extract("file", r"label=(-?[0-9]+)", 1).cast("long")
    features = S.document_entries(documents.select(label.alias("label"), "document"), "document").withColumnRenamed("name", "feature")
    metrics = S.document_entries(features, "entry")  # keys of a feature
    found = S.document_values(metrics.withColumnRenamed("name", "metric"), "entry")
    return found.where("number is not null").withColumn("number", rounded("number"))


@query("A8 files", "", """select block, case when block % 5 = 2 then 'missing' when block % 5 = 3 then 'size changed' end as problem from (
select c_custkey // 50 as block, string_agg(c_name || chr(10), '' order by c_custkey) as fresh,
  string_agg(c_name || chr(10), '' order by c_custkey) || case when c_custkey // 50 % 5 = 3 then 'x' else '' end as claimed from customer group by c_custkey // 50)
where block % 5 = 2 or octet_length(encode(fresh)) <> octet_length(encode(claimed))""")
def verify_file_digests(t: Tables) -> DataFrame:
    """One file per fifty customers; the manifest is made from the table, with wrong entries for some."""
    path = _scratch(t, "objects")
    block = F.floor(F.col("c_custkey") / 50)
    customers = t.table("customer").select(block.alias("block"), "c_custkey", "c_name")
    ordered = customers.repartition("block").sortWithinPartitions("block", "c_custkey")
    ordered.select("block", "c_name").write.partitionBy("block").text(path)
    found = F.regexp_extract("path", r"block=(\d+)", 1).cast("long")
    seen = S.read_objects(t.spark, path).select(found.alias("block"), "content").where(F.col("block") % 5 != 2)
    names = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name")))
    whole = F.concat(F.array_join(F.transform(names, lambda x: x["c_name"]), "\n"), F.lit("\n"))
    claimed = F.when(F.col("block") % 5 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary")
    manifest = customers.groupBy("block").agg(whole.alias("text")).select(
        "block", F.length(claimed).cast("long").alias("size"), F.sha2(claimed, 256).alias("sha256")
    )
    return H.verify_digests(seen, manifest, "block")


@query("A6", "v_episodes", """select split, 0::bigint as chunk_index, episode_index // 10 as file_index, count(*) as episodes, cast(sum(length) as bigint) as frames
from v_episodes group by split, episode_index // 10""")
def data_file_inventory(t: Tables) -> DataFrame:
    return S.data_file_inventory(t.episode_meta)


@query("A7", "v_docs", """select doc_id, row_number() over w as draw_order, cast(sum(size) over w as bigint) as running_size, sum(size) over w <= 100000 as kept
from v_docs window w as (order by sha256(concat('7:', doc_id)), doc_id)""")
def budgeted_sample(t: Tables) -> DataFrame:
    return S.budgeted_sample(t.docs, "doc_id", "size", 100_000, 7).select("doc_id", "draw_order", "running_size", "kept")


@query("A8", "", """select m.doc_id, case when s.doc_id is null then 'missing' when s.size <> m.size then 'size changed' when s.sha <> m.sha then 'content changed' end as problem
from (select doc_id, octet_length(encode(text)) as size, sha256(encode(text)) as sha from documents) m
left join (select case when k = 3 then -1 - doc_id else doc_id end as doc_id, octet_length(b) as size, sha256(b) as sha from (
  select doc_id, k, case k when 5 then encode(text || 'x') when 9 then from_hex(concat(case when substr(hex(encode(text)), 1, 2) = '23' then '21' else '23' end, substr(hex(encode(text)), 3)))
    else encode(text) end as b from (select doc_id, doc_id % 40 as k, text from documents))) s on s.doc_id = m.doc_id
where s.doc_id is null or s.size <> m.size or s.sha <> m.sha""")
def verify_digests(t: Tables) -> DataFrame:
    """The manifest comes from the whole texts; some objects are renamed or altered afterwards."""
    docs = t.table("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    manifest = docs.select("doc_id", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    k = F.col("doc_id") % 40
    longer = F.concat(F.col("content"), F.lit("x").cast("binary"))
    # Same length, other bytes: flip the first byte.
    first = F.when(F.substring("content", 1, 1) == F.lit("#").cast("binary"), F.lit("!").cast("binary")).otherwise(F.lit("#").cast("binary"))
    flipped = F.concat(first, F.substring("content", 2, 2**31 - 1))
    content = F.when(k == 5, longer).when(k == 9, flipped).otherwise(F.col("content"))
    seen = docs.select(F.when(k == 3, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), content.alias("content"))
    return H.verify_digests(seen, manifest, "doc_id")


@query("B8", "v_segments", "select doc_id, camera, doc_id // 1000 as chunk_index, doc_id % 1000 as file_index, from_timestamp, to_timestamp from v_segments")
def long_cameras(t: Tables) -> DataFrame:
    cameras = ("de", "en", "es", "fr")
    wide = t.segments.select("doc_id", *[
        F.when(F.col("camera") == cam, value).alias(f"videos/{cam}/{name}")
        for cam in cameras
        for name, value in (("chunk_index", F.floor(F.col("doc_id") / 1000)), ("file_index", F.col("doc_id") % 1000), ("from_timestamp", F.col("from_timestamp")), ("to_timestamp", F.col("to_timestamp")))
    ])
    long = S.long_cameras(wide, ["doc_id"])
    return long.where(F.col("chunk_index").isNotNull()).select("doc_id", "camera", "chunk_index", "file_index", "from_timestamp", "to_timestamp")


_STD = "case when length > 1 then sqrt((length * length - 1) / 12.0) else 0 end"
_CELLS = {
    "episode_index": ("sum_episode", "sum_episode", "sum_episode", "0"),
    "index": ("sum_index_min", "sum_index_min + length - 1", "sum_index_min + (length - 1) / 2.0", _STD),
    "task_index": ("sum_task", "sum_task", "sum_task", "0"),
    "frame_index": ("0", "length - 1", "(length - 1) / 2.0", _STD),
    "timestamp": ("0", "(length - 1) / 15.0", "(length - 1) / 30.0", f"({_STD}) / 15.0"),
}


@query("B9", "v_episodes", " union all ".join(
    f"select episode_index, '{feature}' as feature, '{metric}' as metric, round(cast({x} as double), 6) + 0.0 as value from v_episodes"
    for feature, cells in _CELLS.items() for metric, x in zip(("min", "max", "mean", "std", "count"), (*cells, "length"))))
def long_features(t: Tables) -> DataFrame:
    long = S.long_features(t.episode_meta, ["episode_index"])
    return long.select("episode_index", "feature", "metric", rounded(F.get("value", F.lit(0))).alias("value"))


# ---- writing -------------------------------------------------------------------------------------


def _tree(values: str, order: str, source: str, key: str = "", fan: int = 4096) -> str:
    """SQL of the three-level digest over ``values`` text in ``order``."""
    k = f"{key}, " if key else ""
    part = f"partition by {key} " if key else ""
    on = f"group by {key}, a // {fan}" if key else f"group by a // {fan}"
    top = f"group by {key}" if key else ""
    return (
        f"select {k}sha256(string_agg(x, chr(10) order by a)) as digest from (select {k}a // {fan} as a, sha256(string_agg(x, chr(10) order by a)) as x from ("
        f"select {k}a // {fan} as a, sha256(string_agg(x, chr(10) order by a)) as x from (select {k}row_number() over ({part}order by {order}) - 1 as a, {values} as x from {source}) {on}) {on}) {top}"
    )


@query("A9", "v_episodes", "select 'chain' as name, (select count(*) from v_episodes) as rows, 'episode_index,length,dataset_from_index' as columns, 'bigint,bigint,bigint' as dtypes, digest from ("
       + _tree("concat_ws('|', episode_index, length, dataset_from_index)", "episode_index", "v_episodes") + ")")
def write_artifact(t: Tables) -> DataFrame:
    table = t.episodes.select("episode_index", "length", "dataset_from_index")
    return W.write_artifact(table, _scratch(t, "artifact"), "chain", ["episode_index"], table.columns)


@query("A10", "v_episodes v_tasks", "select source_prefix, count(*) as episodes, count_if(identity_bad) as identity_bad, 'csv' as format from fnd group by source_prefix union all select source_prefix, count(*), count_if(identity_bad), 'json' from fnd group by source_prefix", extra=FINDINGS_SQL)
def write_report(t: Tables) -> DataFrame:
    """Write the group table both ways and read the files back."""
    report = findings(t).groupBy("source_prefix").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if("identity_bad").alias("identity_bad"))
    csv, json = _scratch(t, "csv"), _scratch(t, "json")
    W.write_report_csv(report, csv, ["source_prefix"])
    W.write_report_json(report, json, ["source_prefix"])
    schema = "source_prefix string, episodes bigint, identity_bad bigint"
    return t.spark.read.schema(schema).csv(csv, header=True).withColumn("format", F.lit("csv")).unionByName(
        t.spark.read.schema(schema).json(json).withColumn("format", F.lit("json")))


@query("A11", "", """select source, doc_id, f // 3 as chunk_index, f % 3 as file_index, from_g as dataset_from_index, from_g + len as dataset_to_index, from_f as faulty_from_index
from r""", extra=f"""it as (select source, doc_id, n_chars as size, doc_id % 11 + 1 as len, row_number() over (partition by source order by doc_id) as k from documents),
r as (select source, doc_id, k, len, 0::bigint as f, 0::bigint as from_g, 0::bigint as from_f,
    size as acc, size >= {DATA_CAP} as closed, size from it where k = 1
  union all select i.source, i.doc_id, i.k, i.len, r.f + case when r.closed then 1 else 0 end, r.from_g + r.len,
    case when r.closed then r.len else r.from_f + r.len end,
    case when r.closed then r.size else r.acc end + i.size, case when r.closed then r.size else r.acc end + i.size >= {DATA_CAP}, i.size
  from r join it i on i.source = r.source and i.k = r.k + 1)""")
def pack_data_files(t: Tables) -> DataFrame:
    items = t.docs.withColumn("len", F.col("doc_id") % 11 + 1)
    out = Q.pack_data_files(items, ["source"], ["doc_id"], "size", "len", DATA_CAP, chunk_files=3)
    return out.drop("size", "len")


@query("A12", "", """select source, doc_id, f // 3 as chunk_index, f % 3 as file_index, round(acc0 / 15.0, 6) + 0.0 as from_timestamp, round((acc0 + size) / 15.0, 6) + 0.0 as to_timestamp from r""",
       extra=f"""it as (select source, doc_id, n_chars as size, row_number() over (partition by source order by doc_id) as k from documents),
r as (select source, doc_id, k, size, 0::bigint as f, 0::bigint as acc0 from it where k = 1
  union all select i.source, i.doc_id, i.k, i.size, r.f + case when r.acc0 + r.size + i.size >= {SEGMENT_CAP} then 1 else 0 end,
    case when r.acc0 + r.size + i.size >= {SEGMENT_CAP} then 0 else r.acc0 + r.size end
  from r join it i on i.source = r.source and i.k = r.k + 1)""")
def pack_segments(t: Tables) -> DataFrame:
    out = Q.pack_segments(t.docs, ["source"], ["doc_id"], "size", SEGMENT_CAP, UNITS_PER_SECOND, chunk_files=3)
    return out.drop("size").withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("from_timestamp", "to_timestamp")})


@query("A13", "v_episodes", """select episode_index, 'base' as added, task, length, dataset_from_index, dataset_to_index, episode_index // 10 as file_index from v_episodes
union all select n + 1 + k, added, 'new task', len, z + before, z + before + len, n // 10 + case when added = 'later' then 1 else 2 end from e, late""",
       extra="""e as (select max(episode_index) as n, max(dataset_to_index) as z from v_episodes),
late as (select * from (values ('later', 0, 33, 0), ('later', 1, 7, 33), ('last', 2, 12, 40)) v(added, k, len, before))""")
def append_episodes(t: Tables) -> DataFrame:
    """A stored set, an append that is run twice, and another one, read back."""
    path = _scratch(t, "episode-store")
    store.append_episodes(path, t.episodes.select("task", "length", F.lit("base").alias("added"), F.col("episode_index").alias("k")), ["k"], "base")
    late = t.spark.createDataFrame([("later", 0, 33), ("later", 1, 7), ("last", 2, 12)], "added string, k long, length long").withColumn("task", F.lit("new task"))
    for name in ("later", "later", "last"):
        store.append_episodes(path, late.where(F.col("added") == name), ["k"], name)
    columns = ("episode_index", "added", "task", "length", "dataset_from_index", "dataset_to_index", "file_index")
    return store.read_store(t.spark, path).select(*columns)


@query("C10", "v_episodes", """select episode_index, '' as absent_from, length, dataset_from_index, camera, cast(sum_episode as double) as episode_min from (
  select *, concat('cam', episode_index % 4) as camera from v_episodes) where not (episode_index % 9 = 1 or episode_index % 9 = 2 or episode_index % 9 = 3)
union all select episode_index, concat_ws(',', case when episode_index % 9 = 1 then 'offsets' end, case when episode_index % 9 = 2 then 'segments' end, case when episode_index % 9 = 3 then 'stats' end), null, null, null, null
from v_episodes where episode_index % 9 in (1, 2, 3)""")
def merge_episode_metadata(t: Tables) -> DataFrame:
    """Merged rows, followed by the episodes that some source lacks."""
    m, k = t.episode_meta, F.col("episode_index") % 9
    merged, lacking = S.merge_episode_metadata(
        m.select("episode_index", "length"),
        m.where(k != 1).select("episode_index", "dataset_from_index"),
        m.where(k != 2).select("episode_index", F.concat(F.lit("cam"), (F.col("episode_index") % 4).cast("string")).alias("camera")),
        m.where(k != 3).select("episode_index", L.cell("episode_index", "min").alias("episode_min")),
    )
    return merged.withColumn("absent_from", F.lit("")).unionByName(lacking, allowMissingColumns=True)


# ---- digests -------------------------------------------------------------------------------------


@query("X1", "v_frames", _tree("concat_ws('|', frame_index, index, task_index)", "frame_index", "v_frames", "episode_index", 16))
def group_digest(t: Tables) -> DataFrame:
    return H.group_digest(t.frames, ["episode_index"], ["frame_index"], ["frame_index", "index", "task_index"], fan=16)


def _ledger(t: Tables) -> DataFrame:
    """One ledger per order priority; some payloads and links were altered after signing."""
    from episcope.operators.ordered import deal, running

    key = F.col("o_orderkey")
    base = t.table("orders").select(
        F.col("o_orderpriority").alias("ledger"), "o_orderkey",
        F.concat_ws(":", key.cast("string"), "o_orderstatus").alias("payload"))
    run = running(deal(base, ["ledger"], ["o_orderkey"]), number="sequence", leads={"_next": "o_orderkey"})
    ends = F.col("_next").isNull() | ((F.col("ledger") == "5-LOW") & (F.col("sequence") == 10))
    signed = run.rows.withColumns({
        "binding": F.lit("b" * 8), "event": F.when(ends, "RUN_COMPLETE").otherwise("STEP"),
    }).withColumn("claimed", F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "binding", "event", "payload"), 256))
    linked = running(run.over(signed), lags={"_before": "claimed"}).done()
    return linked.withColumns({
        "previous": F.when(key % 50 == 7, "f" * 64).otherwise(F.coalesce("_before", F.lit("0" * 64))),
        "payload": F.when(key % 50 == 3, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")),
        "sequence": F.when((F.col("ledger") == "1-URGENT") & (F.col("sequence") > 100), F.col("sequence") + 1).otherwise(F.col("sequence")),
    })


@query("X2", "", """select *, sequence_breaks = 0 and predecessor_breaks = 0 and digest_mismatches = 0 and bindings = 1 and terminals = 1 and terminal_is_last as accepted from (
select ledger, count(*) as events, count_if(sequence <> n) as sequence_breaks, count_if(previous <> coalesce(before, repeat('0', 64))) as predecessor_breaks,
  count_if(claimed <> sha256(concat_ws('|', sequence, binding, event, payload))) as digest_mismatches, count(distinct binding) as bindings,
  count_if(event = 'RUN_COMPLETE') as terminals, max_by(event = 'RUN_COMPLETE', sequence) as terminal_is_last
from (select *, row_number() over (partition by ledger order by sequence) as n, lag(claimed) over (partition by ledger order by sequence) as before from bent) group by ledger)""",
       extra="""signed as (select ledger, k, s, 'bbbbbbbb' as binding, event, payload, sha256(concat_ws('|', s, 'bbbbbbbb', event, payload)) as claimed from (
  select o_orderpriority as ledger, o_orderkey as k, row_number() over w as s, concat_ws(':', o_orderkey, o_orderstatus) as payload,
    case when lead(o_orderkey) over w is null or (o_orderpriority = '5-LOW' and row_number() over w = 10) then 'RUN_COMPLETE' else 'STEP' end as event
  from orders window w as (partition by o_orderpriority order by o_orderkey))),
bent as (select ledger, binding, event, claimed, case when k % 50 = 7 then repeat('f', 64) else coalesce(lag(claimed) over (partition by ledger order by s), repeat('0', 64)) end as previous,
  case when k % 50 = 3 then payload || '!' else payload end as payload, case when ledger = '1-URGENT' and s > 100 then s + 1 else s end as sequence from signed)""")
def ledger_verify(t: Tables) -> DataFrame:
    out = H.ledger_verify(_ledger(t), ["sequence", "binding", "event", "payload"])
    return out.withColumn("accepted", H.ledger_accepted())


@query("X3", "v_vec", """select episode_index, array_name, case when episode_index % 5 = 1 then 'changed' when array_name = 'actions' then 'missing' else 'unexpected' end as problem from (
select distinct episode_index, unnest(['state', 'actions']) as array_name from v_vec) where episode_index % 5 = 1 or (episode_index % 5 = 2 and array_name = 'actions') or (episode_index % 5 = 3 and array_name = 'state')""")
def inventory_reconcile(t: Tables) -> DataFrame:
    frozen = H.array_inventory(t.vectors, ["episode_index"], ["frame_index"], ["state", "actions"])
    e, n = F.col("episode_index"), F.col("array_name")
    swapped: Column = F.when((e % 5 == 1) & (F.col("frame_index") == 4), F.transform("state", lambda x: x + F.lit(1.0).cast("float"))).otherwise(F.col("state"))
    bent = t.vectors.withColumn("state", swapped).withColumn(
        "actions", F.when((e % 5 == 1) & (F.col("frame_index") == 6), F.reverse("actions")).otherwise(F.col("actions")))
    fresh = H.array_inventory(bent, ["episode_index"], ["frame_index"], ["state", "actions"]).where(~((e % 5 == 2) & (n == "actions")))
    return H.inventory_reconcile(fresh, frozen.where(~((e % 5 == 3) & (n == "state"))), ["episode_index"])

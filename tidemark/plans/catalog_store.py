"""Queries for the evidence store: hashing, merges, ranking, search and monitoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.numeric import rnd
from tidemark.operators import joins as J
from tidemark.operators import merge as M
from tidemark.operators import rank as R
from tidemark.plans.registry import query
from tidemark.session import shared_dir
from tidemark.sources import tables as T
from tidemark.sources.tables import table

COMPANIES = """companies AS (SELECT 'C' || c_custkey AS ticker, 'US.C' || c_custkey AS code, c_name AS name, c_mktsegment AS sector,
  CASE WHEN c_acctbal < 0 THEN '' ELSE 'N' || c_nationkey END AS industry, c_acctbal AS balance FROM customer)"""
SCORES = """scores AS (SELECT 'C' || o_custkey AS ticker, o_orderkey AS run_id, round(o_totalprice / 5000, 2) AS total_score,
  o_orderpriority AS model_version, o_orderdate AS scored_at FROM orders)"""
LATEST = f"""{COMPANIES}, {SCORES},
ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY scored_at DESC, run_id DESC) AS k FROM scores) WHERE k = 1),
latest AS (SELECT ls.ticker, run_id, total_score, scored_at, code, name, sector, industry,
  coalesce(nullif(industry, ''), nullif(sector, ''), 'Unclassified') AS sector_group FROM ls JOIN companies USING (ticker))"""
ITEMS = """items AS (SELECT event_id AS item_id, 'U' || user_id AS ticker, event_type AS dimension,
  's' || json_extract_string(props, '$.k') AS source_key, event_type AS title, '' AS source_url,
  CASE WHEN event_type <> 'purchase' THEN CAST(ts AS DATE) END AS event_date, ts AS created_at,
  round(value / 5, 2) AS importance_score, value, user_id FROM events)"""
OBS = """obs AS (SELECT l_orderkey AS run_id, 'P' || l_partkey AS ticker, 's' || l_linenumber AS source_key,
  CASE WHEN l_returnflag = 'R' THEN 'fetch_error' ELSE 'fetch_' || lower(l_linestatus) END AS observation_type,
  l_returnflag AS title, l_linestatus AS source_url, l_shipdate AS fetched_at, 'f' || l_returnflag AS mkey,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS mval FROM lineitem)"""
RUNS = """runs AS (SELECT o_orderkey AS run_id, list_transform(range(0, o_custkey % 5 + 1), lambda i: 'S' || ((o_custkey + i) % 100)) AS tickers,
  CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
  o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS finished_at,
  o_orderpriority < '3' AS with_flags FROM orders)"""


def latest(spark, d):
    return R.scored_companies(T.scores(spark, d), T.companies(spark, d))


def ts_text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


# --- merges -----------------------------------------------------------------------------


@query("b01_content_hash", "SELECT doc_id, sha256(concat(source, chr(0), lang, chr(0), text, chr(0))) AS content_hash FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", M.stable_hash("source", "lang", "text").alias("content_hash"))


@query(
    "b02_observation_ingest",
    f"""WITH {OBS}, h AS (SELECT *, sha256(concat(ticker, chr(0), source_key, chr(0), observation_type, chr(0), coalesce(title, ''), chr(0), coalesce(source_url, ''), chr(0))) AS raw_hash FROM obs),
    m AS (SELECT ticker, source_key, observation_type, raw_hash, mkey, last(mval ORDER BY fetched_at, run_id) AS mval FROM h GROUP BY ALL),
    mm AS (SELECT ticker, source_key, observation_type, raw_hash, string_agg(mkey || '=' || mval, ',' ORDER BY mkey) AS metadata FROM m GROUP BY ALL)
    SELECT h.ticker, h.source_key, h.observation_type, h.raw_hash, first(title ORDER BY fetched_at, run_id, title, source_url) AS title,
      first(source_url ORDER BY fetched_at, run_id, title, source_url) AS source_url, last(run_id ORDER BY fetched_at, run_id) AS run_id,
      CAST(CAST(max(fetched_at) AS DATE) AS VARCHAR) AS fetched_at, any_value(metadata) AS metadata
    FROM h JOIN mm USING (ticker, source_key, observation_type, raw_hash) GROUP BY ALL""",
)
def _(spark, d):
    obs = T.observations(spark, d).withColumn("raw_hash", M.stable_hash("ticker", "source_key", "observation_type", "title", "source_url"))
    out = M.merge_observations(obs)
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.withColumn("metadata", F.array_join(F.array_sort(pairs), ",")).withColumn("fetched_at", F.to_date("fetched_at").cast("string"))


@query(
    "b03_company_upsert",
    """WITH v AS (SELECT 'C' || o_custkey AS ticker, o_orderkey AS version, o_orderpriority AS market,
      CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'name-' || o_orderkey END AS name,
      CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderpriority END AS sector,
      CASE WHEN o_totalprice < 250000 THEN '' ELSE 'ind-' || o_orderstatus END AS industry FROM orders)
    SELECT ticker, max(version) AS version, arg_max(market, version) AS market,
      arg_max(name, version) FILTER (name <> '') AS name, arg_max(sector, version) FILTER (sector <> '') AS sector,
      arg_max(industry, version) FILTER (industry <> '') AS industry FROM v GROUP BY ticker""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    v = o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.col("o_orderkey").alias("version"),
        F.col("o_orderpriority").alias("market"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("name-"), F.col("o_orderkey").cast("string"))).alias("name"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderpriority")).alias("sector"),
        F.when(F.col("o_totalprice") < 250000, "").otherwise(F.concat(F.lit("ind-"), F.col("o_orderstatus"))).alias("industry"),
    )
    return M.merge_companies(v, ("name", "sector", "industry"))


@query(
    "b04_append_items",
    f"""WITH {ITEMS} SELECT dimension, 2 * count(*) AS item_count, CAST(min(item_id) AS BIGINT) AS first_item,
    CAST(max(item_id) AS BIGINT) AS last_item FROM items GROUP BY dimension""",
)
def _(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    batch = T.items(spark, d)
    J.append_items(batch, path)
    J.append_items(batch, path)
    stored = spark.read.parquet(path)
    return stored.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("item_count"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item")
    )


@query(
    "b05_score_upsert",
    f"""WITH {SCORES} SELECT run_id, ticker, model_version, last(total_score ORDER BY scored_at) AS total_score FROM scores GROUP BY run_id, ticker, model_version""",
)
def _(spark, d):
    s = T.scores(spark, d)
    return M.latest_per_key(s, ["run_id", "ticker", "model_version"], ["scored_at"]).select("run_id", "ticker", "model_version", "total_score")


EVENT_ROWS = """ev AS (SELECT 'C' || o_custkey AS ticker, o_orderpriority AS title, o_orderstatus AS source_key, '' AS source_url,
  CAST(o_orderdate AS DATE) AS event_date, round(o_totalprice / 5000, 2) AS importance_score,
  CAST(o_orderkey % 100 AS DOUBLE) AS confidence_score, o_orderkey AS version FROM orders)"""


def event_rows(spark, d):
    return table(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("source_key"),
        F.lit("").alias("source_url"),
        F.to_date("o_orderdate").alias("event_date"),
        F.round(F.col("o_totalprice") / 5000, 2).alias("importance_score"),
        (F.col("o_orderkey") % 100).cast("double").alias("confidence_score"),
        F.col("o_orderkey").alias("version"),
    )


@query(
    "b06_future_event_upsert",
    f"""WITH {EVENT_ROWS}, b AS (SELECT *, CASE WHEN source_key = 'P' THEN 0 ELSE 1 END AS side FROM ev)
    SELECT ticker, title, source_key, source_url, last(CAST(event_date AS VARCHAR) ORDER BY side, version) AS event_date,
    last(importance_score ORDER BY side, version) AS importance_score, last(version ORDER BY side, version) AS version
    FROM b GROUP BY ticker, title, source_key, source_url""",
)
def _(spark, d):
    ev = event_rows(spark, d)
    stored, incoming = ev.filter(F.col("source_key") == "P"), ev.filter(F.col("source_key") != "P")
    out = M.upsert(stored, incoming, ["ticker", "title", "source_key", "source_url"])
    return out.withColumn("event_date", F.col("event_date").cast("string")).drop("confidence_score")


ACTIONS = """acts AS (SELECT 'C' || o_custkey AS ticker, CASE WHEN o_orderstatus = 'F' THEN 'unwatch' ELSE 'watch' END AS action,
  o_orderpriority AS note, o_orderkey AS moment FROM orders)"""
WATCHED = f"""{ACTIONS}, gone AS (SELECT ticker, max(CASE WHEN action = 'unwatch' THEN moment END) AS gone FROM acts GROUP BY ticker),
  watched AS (SELECT a.ticker, min(moment) AS watched_at, arg_max(note, moment) AS note FROM acts a JOIN gone g USING (ticker)
  WHERE gone IS NULL OR moment > gone GROUP BY a.ticker)"""


def watched(spark, d):
    acts = table(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.when(F.col("o_orderstatus") == "F", "unwatch").otherwise("watch").alias("action"),
        F.col("o_orderpriority").alias("note"),
        F.col("o_orderkey").alias("at"),
    )
    return M.watchlist(acts)


@query("b07_watchlist", f"WITH {WATCHED} SELECT ticker, watched_at, note FROM watched")
def _(spark, d):
    return watched(spark, d)


@query(
    "b08_report_upsert",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS report_date, o_orderstatus AS session_label,
    max(o_orderkey) AS version, arg_max(o_orderpriority, o_orderkey) AS snapshot FROM orders GROUP BY ALL""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.to_date("o_orderdate").cast("string").alias("report_date"),
        F.col("o_orderstatus").alias("session_label"),
        F.col("o_orderkey").alias("version"),
        F.col("o_orderpriority").alias("snapshot"),
    )
    return M.latest_per_key(o, ["report_date", "session_label"], ["version"])


# --- joins over the store ----------------------------------------------------------------


@query("d01_scores_with_companies", f"WITH {LATEST} SELECT ticker, total_score, name, sector_group FROM latest")
def _(spark, d):
    return latest(spark, d).select("ticker", "total_score", "name", "sector_group")


@query(
    "d02_watchlist_scores",
    f"WITH {LATEST}, {WATCHED} SELECT w.ticker, w.note, w.watched_at, c.name, l.total_score FROM watched w JOIN companies c USING (ticker) LEFT JOIN ls l USING (ticker)",
)
def _(spark, d):
    w = watched(spark, d).join(T.companies(spark, d), "ticker")
    return w.join(R.latest_scores(T.scores(spark, d)), "ticker", "left").select("ticker", "note", "watched_at", "name", "total_score")


@query(
    "d15_merge_events",
    f"""WITH {EVENT_ROWS}, g AS (SELECT *, CASE source_key WHEN 'F' THEN 0 ELSE -1 END AS grp FROM ev),
    k AS (SELECT *, row_number() OVER (PARTITION BY ticker, event_date, title, source_key ORDER BY confidence_score DESC, importance_score DESC, grp DESC) AS n FROM g)
    SELECT ticker, CAST(event_date AS VARCHAR) AS event_date, title, source_key, confidence_score, importance_score FROM k WHERE n = 1""",
)
def _(spark, d):
    ev = event_rows(spark, d)
    out = M.merge_events(ev.filter(F.col("source_key") == "F"), ev.filter(F.col("source_key") != "F"))
    return out.select("ticker", F.col("event_date").cast("string"), "title", "source_key", "confidence_score", "importance_score")


# --- ranking -----------------------------------------------------------------------------


@query("i01_latest_per_ticker", f"WITH {LATEST} SELECT ticker, run_id, total_score, {ts_sql('scored_at')} FROM ls")
def _(spark, d):
    return R.latest_scores(T.scores(spark, d)).select("ticker", "run_id", "total_score", ts_text("scored_at"))


@query(
    "i02_ranked_candidates",
    f"""WITH {LATEST} SELECT ticker, total_score, sector_group FROM latest
    WHERE total_score >= 20 AND sector_group <> '' AND (ticker ILIKE '%C1%' OR code ILIKE '%C1%' OR name ILIKE '%C1%' OR sector ILIKE '%C1%' OR industry ILIKE '%C1%')
    ORDER BY total_score DESC, scored_at DESC, ticker LIMIT 100""",
)
def _(spark, d):
    return R.ranked_scores(latest(spark, d), min_score=20, query="c1").select("ticker", "total_score", "sector_group")


@query(
    "i03_top_per_sector",
    f"""WITH {LATEST}, r AS (SELECT *, row_number() OVER (PARTITION BY sector_group ORDER BY total_score DESC, scored_at DESC, ticker) AS sector_rank
    FROM latest WHERE total_score >= 10) SELECT ticker, sector_group, total_score, sector_rank FROM r WHERE sector_rank <= 5""",
)
def _(spark, d):
    out = R.top_per_sector(latest(spark, d), 5, min_score=10)
    return out.select("ticker", "sector_group", "total_score", F.col("sector_rank").cast("bigint").alias("sector_rank"))


@query(
    "i04_sector_rollup",
    f"WITH {LATEST} SELECT sector_group AS sector, count(*) AS candidate_count, max(total_score) AS best_score FROM latest GROUP BY 1",
)
def _(spark, d):
    return R.sector_rollup(latest(spark, d))


@query(
    "i05_candidates_by_sector",
    f"""WITH {LATEST}, t AS (SELECT sector_group, string_agg(ticker, ',' ORDER BY total_score DESC, ticker) AS names
      FROM latest GROUP BY 1),
    a AS (SELECT sector_group, count(*) AS candidate_count, max(total_score) AS best_score FROM latest GROUP BY 1)
    SELECT a.sector_group AS sector, candidate_count, best_score, coalesce(names, '') AS candidates FROM a LEFT JOIN t USING (sector_group)""",
)
def _(spark, d):
    return R.grouped_by_sector(latest(spark, d)).withColumn("candidates", F.array_join("candidates", ","))


@query(
    "i06_search",
    f"""WITH {LATEST}, r AS (SELECT *, row_number() OVER (PARTITION BY sector_group ORDER BY total_score DESC, scored_at DESC, ticker) AS sector_rank FROM latest)
    SELECT ticker, total_score, sector_rank, CAST(CASE WHEN ticker = 'C12' THEN 0 WHEN ticker ILIKE 'c12%' THEN 1 WHEN code ILIKE 'c12%' THEN 2
      WHEN name ILIKE 'c12%' THEN 3 ELSE 4 END AS BIGINT) AS match_level
    FROM r WHERE ticker ILIKE '%c12%' OR code ILIKE '%c12%' OR name ILIKE '%c12%'
    ORDER BY match_level, total_score DESC, scored_at DESC, ticker LIMIT 50""",
)
def _(spark, d):
    out = R.search_scores(latest(spark, d), "c12")
    return out.select(
        "ticker", "total_score", F.col("sector_rank").cast("bigint").alias("sector_rank"), F.col("match_level").cast("bigint").alias("match_level")
    )


@query(
    "i07_timeline",
    f"""WITH {ITEMS}, u AS (SELECT *, row_number() OVER (PARTITION BY ticker, dimension, source_key, title, event_date, source_url
      ORDER BY created_at DESC, importance_score DESC, item_id DESC) AS n FROM items WHERE importance_score >= 20),
    p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC NULLS LAST, created_at DESC, importance_score DESC, item_id DESC) AS place FROM u WHERE n = 1)
    SELECT ticker, item_id, dimension, place FROM p WHERE place <= 20""",
)
def _(spark, d):
    out = R.timeline(T.items(spark, d), min_importance=20, limit=20)
    return out.select("ticker", "item_id", "dimension", F.col("place").cast("bigint").alias("place"))


@query(
    "i08_latest_items",
    f"""WITH {ITEMS}, p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC NULLS LAST, created_at DESC, item_id DESC) AS place FROM items)
    SELECT ticker, item_id, place FROM p WHERE place <= 30""",
)
def _(spark, d):
    return R.latest_items(T.items(spark, d), 30).select("ticker", "item_id", F.col("place").cast("bigint").alias("place"))


@query(
    "i08_latest_in_dimension",
    f"WITH {ITEMS} SELECT ticker, max(item_id) AS item_id FROM items WHERE dimension = 'click' GROUP BY ticker",
)
def _(spark, d):
    return R.latest_in_dimension(T.items(spark, d), "click").select("ticker", "item_id")


@query(
    "i09_upcoming_events",
    f"""WITH {EVENT_ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_date ASC NULLS LAST, importance_score DESC, version DESC, title) AS place FROM ev)
    SELECT ticker, version, place FROM k WHERE place <= 5""",
)
def _(spark, d):
    ev = event_rows(spark, d).withColumn("created_at", F.col("version"))
    return R.upcoming_events(ev, 5).select("ticker", "version", F.col("place").cast("bigint").alias("place"))


@query(
    "i10_latest_run",
    f"""WITH {RUNS}, x AS (SELECT unnest(tickers) AS ticker, run_id, status, coalesce(finished_at, started_at) AS moment FROM runs)
    SELECT ticker, last(run_id ORDER BY moment, run_id) AS run_id, last(status ORDER BY moment, run_id) AS status FROM x GROUP BY ticker""",
)
def _(spark, d):
    return R.latest_runs(T.runs(spark, d)).select("ticker", "run_id", "status")


@query(
    "i11_report_history",
    """SELECT o_orderkey AS report_id, o_orderpriority AS as_of, o_orderstatus <> 'P' AS has_advice FROM orders
    ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC LIMIT 50""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("report_id"),
        F.to_date("o_orderdate").alias("report_date"),
        F.lit("pre_open").alias("session_label"),
        F.to_json(F.struct(F.col("o_orderpriority").alias("as_of"))).alias("snapshot"),
        F.when(F.col("o_orderstatus") != "P", F.create_map(F.lit("call"), "o_orderstatus"))
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("advice"),
        F.col("o_orderkey").alias("updated_at"),
    )
    return R.regime_history(o, 50).select("report_id", "as_of", "has_advice")


MONITOR = f"""{ITEMS}, {OBS}, mon AS (
  SELECT user_id AS run_id, dimension AS key, count(*) AS item_count, count(DISTINCT source_key) AS ticker_count, max(created_at) AS latest_at, 'dimension' AS kind FROM items GROUP BY ALL
  UNION ALL SELECT o_custkey, 'score', count(*), count(DISTINCT o_orderpriority), max(o_orderdate), 'score' FROM orders GROUP BY ALL
  UNION ALL SELECT run_id, observation_type, count(*), count(DISTINCT ticker), max(fetched_at), 'observation' FROM obs GROUP BY ALL
  UNION ALL SELECT run_id, source_key, count(*), count(DISTINCT ticker), max(fetched_at), 'source' FROM obs GROUP BY ALL)"""


def monitor(spark, d):
    e = table(spark, d, "events")
    it = e.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("dimension"),
        F.concat(F.lit("s"), F.get_json_object("props", "$.k")).alias("ticker"),
        F.col("ts").alias("created_at"),
    )
    sc = table(spark, d, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").alias("scored_at")
    )
    return R.run_monitor(it, sc, T.observations(spark, d))


@query(
    "i12_run_monitor",
    f"""WITH {MONITOR} SELECT run_id, kind, key, item_count, ticker_count, {ts_sql('latest_at')},
    CAST(CASE WHEN kind = 'observation' AND key LIKE '%\\_error' ESCAPE '\\' THEN item_count ELSE 0 END AS BIGINT) AS error_count FROM mon""",
)
def _(spark, d):
    out = monitor(spark, d)
    return out.select("run_id", "kind", "key", "item_count", "ticker_count", ts_text("latest_at"), F.col("error_count").cast("bigint").alias("error_count"))


def registry_literal():
    """Source registry of the progress query: two default sources and one behind a run flag."""

    def source(key, flag, default, dims):
        return F.struct(
            F.lit(key).alias("source_key"), F.lit(flag).alias("flag"), F.lit(default).alias("default_enabled"), S.literal_array(dims).alias("dimensions")
        )

    return F.array(
        source("pages", "", True, ("click", "view")), source("forms", "with_flags", False, ("signup", "view")), source("off", "", False, ("error",))
    )


@query(
    "i13_run_progress",
    f"""WITH {RUNS}, {MONITOR}, base AS (SELECT run_id, status, CAST(len(tickers) AS BIGINT) AS total,
      unnest(CASE WHEN with_flags THEN ['click', 'view', 'signup', 'score'] ELSE ['click', 'view', 'score'] END) AS key FROM runs),
    j AS (SELECT b.*, coalesce(ticker_count, 0) AS n FROM base b LEFT JOIN (SELECT * FROM mon WHERE kind IN ('dimension', 'score')) m USING (run_id, key)),
    a AS (SELECT run_id, any_value(status) AS status, any_value(total) AS total, CAST(sum(least(n, total)) AS BIGINT) AS completed_slots,
      CAST(sum(total) AS BIGINT) AS expected_slots FROM j GROUP BY run_id)
    SELECT *, round(least(100, CASE WHEN status = 'DONE' THEN 100 ELSE completed_slots * 100.0 / expected_slots END), 1) AS percent FROM a""",
)
def _(spark, d):
    return R.run_progress(T.runs(spark, d), monitor(spark, d), registry_literal())


@query(
    "i14_source_listing",
    """WITH g AS (SELECT l_returnflag AS scope, 's' || l_suppkey AS source_key, count(*) AS observation_count FROM lineitem GROUP BY ALL)
    SELECT *, count(*) OVER (PARTITION BY scope) AS sources_in_scope FROM g""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    sources = li.groupBy(
        F.col("l_returnflag").alias("scope"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_key")
    ).agg(F.count(F.lit(1)).alias("observation_count"))
    return J.source_listing(sources)


@query(
    "i15_screen_report",
    f"""WITH {LATEST} SELECT ticker, CAST(row_number() OVER (ORDER BY total_score DESC, ticker) AS BIGINT) AS place,
      printf('%.2f', total_score) AS score,
      CASE WHEN abs(balance * 1e6) >= 1e9 THEN printf('$%.2fB', balance * 1e6 / 1e9) WHEN abs(balance * 1e6) >= 1e6 THEN printf('$%.1fM', balance * 1e6 / 1e6)
        ELSE 'small' END AS market_cap
    FROM latest JOIN companies USING (ticker)""",
)
def _(spark, d):
    return J.screen_report(latest(spark, d).withColumn("market_cap", F.col("balance") * 1e6))


# --- symbol lists -------------------------------------------------------------------------


@query(
    "a05_clean_symbols",
    """WITH s AS (SELECT p_partkey AS pos, upper(trim(replace(p_name, ' ', '.'))) AS raw FROM part),
    c AS (SELECT pos, CASE WHEN contains(raw, '.') THEN substr(raw, instr(raw, '.') + 1) ELSE raw END AS symbol FROM s)
    SELECT symbol, min(pos) AS position FROM c WHERE symbol <> '' GROUP BY symbol""",
)
def _(spark, d):
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("position"), F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("."))).alias("symbol"))
    return J.clean_symbols(raw)


@query(
    "a07_merge_symbols",
    """WITH u AS (SELECT 0 AS src, c_custkey AS pos, upper(c_mktsegment) AS symbol FROM customer UNION ALL
      SELECT 1, p_partkey, upper(p_type) FROM part UNION ALL SELECT 2, s_suppkey, upper(s_name) FROM supplier),
    f AS (SELECT symbol, src, pos, row_number() OVER (PARTITION BY symbol ORDER BY src, pos) AS k FROM u),
    r AS (SELECT symbol, row_number() OVER (ORDER BY src, pos) AS position FROM f WHERE k = 1)
    SELECT symbol, position FROM r WHERE position > 3 AND position <= 33""",
)
def _(spark, d):
    lists = [
        table(spark, d, "customer").select(F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("symbol")),
        table(spark, d, "part").select(F.col("p_partkey").alias("position"), F.col("p_type").alias("symbol")),
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_name").alias("symbol")),
    ]
    return J.symbol_batch(J.merge_symbol_lists(*lists), offset=3, limit=30)

"""Token, snapshot-comparison, registry and chain queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.functions.wordlists import NATIVE_ADDRESS
from newsweave.operators.articles import (
    filter_and_sort,
    new_articles,
    refresh_report,
    search_windows,
    within_window,
)
from newsweave.operators.chains import with_chain_id, with_chain_name, with_rpc_urls
from newsweave.operators.registry import drop_native, new_candidates
from newsweave.operators.tokens import prepare_tokens, query_plan
from newsweave.plans.registry import RegistryRefresh, refresh_registry
from newsweave.plans.runs import run_registry
from newsweave.schemas import TOKEN
from newsweave.session import configure, shared_folder
from newsweave.settings import Settings
from newsweave.sources import landed
from newsweave.sources.registry_files import read_listed_tokens, read_registry, write_registry

from . import sql
from .articles import REFRESH_INPUT_CTES
from .sql import AS_OF, q
from .views import DAY, _token_of, as_of, documents, refresh_inputs, table, token_rows

# -- tokens ------------------------------------------------------------------------


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tokens: 0 to 4 additional phrases each, thresholds for some."""
    key = F.col("p_partkey")
    extra = F.array("p_name", "p_brand", "p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    values = {
        "name": F.col("p_name"),
        "symbol": F.concat(F.lit("P"), key.cast("string")),
        "address": F.create_map(F.lit("chain"), key.cast("string")),
        "lookback_years": F.when(key % 3 > 0, (key % 3).cast("int")),
        "relevance_threshold": F.when(key % 2 == 0, F.lit(8.0)),
        "mandatory_phrases": F.when(key % 4 > 0, F.array("p_brand")),
        "additional_phrases": F.slice(extra, F.lit(1), (key % 5).cast("int")),
        "rss_feeds": F.lit(None),
    }
    parts = table(spark, sf_dir, "part")
    return prepare_tokens(
        parts.select(
            F.lower(values["symbol"]).alias("token_key"),
            *(values[f.name].cast(f.dataType).alias(f.name) for f in TOKEN),
        )
    )


def planned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_plan(part_tokens(spark, sf_dir))


QUERY_PLAN_SQL = """
WITH RECURSIVE t AS (
    SELECT 'p' || p_partkey AS token_key,
           p_name || ' P' || p_partkey || ' ' || CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE '' END AS base,
           list_slice([p_name, p_brand, p_type, 'size ' || p_size], 1, p_partkey % 5) AS extra
    FROM part),
c AS (
    SELECT token_key, base, extra, 0 AS last, 0::BIGINT AS n_phrases, ''::VARCHAR AS combo,
           (1 << len(extra))::BIGINT AS total, 0::BIGINT AS mask
    FROM t
    UNION ALL
    SELECT token_key, base, extra, i, n_phrases + 1,
           CASE WHEN n_phrases = 0 THEN extra[i] ELSE combo || ' ' || extra[i] END,
           total, mask + (1::BIGINT << (len(extra) - i)::BIGINT)
    FROM c, LATERAL (SELECT unnest(range(last + 1, len(extra) + 1))::INTEGER AS i) n)
SELECT token_key, (n_phrases * total + total - 1 - mask)::BIGINT AS query_order, n_phrases,
       CASE WHEN n_phrases = 0 THEN base ELSE base || ' ' || combo END AS query
FROM c
"""


def token_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = part_tokens(spark, sf_dir)
    return tokens.select(
        "token_key",
        F.array_join("keywords", "|").alias("keywords"),
        F.array_join("phrases", "|").alias("phrases"),
        "threshold",
        F.col("lookback_years").cast("bigint").alias("lookback_years"),
    )


TOKEN_REGISTRY_SQL = """
SELECT 'p' || p_partkey AS token_key,
       lower(p_name || '|P' || p_partkey || CASE WHEN p_partkey % 4 > 0 THEN '|' || p_brand ELSE '' END) AS keywords,
       lower(array_to_string(list_slice([p_name, p_brand, p_type, 'size ' || p_size], 1, p_partkey % 5), '|')) AS phrases,
       CASE WHEN p_partkey % 2 = 0 THEN 8e0 ELSE 6.5e0 END AS threshold,
       CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 ELSE 2 END::BIGINT AS lookback_years
FROM part
"""


def token_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows: each token's own, and the shared ones, which name no token."""
    inputs = refresh_inputs(spark, sf_dir)
    shared = inputs["default_feed"].withColumn("token_key", F.lit(None).cast("string"))
    both = shared.unionByName(inputs["token_feed"])
    return both.select(
        "token_key", "title", "link", "source", "timestamp", "tag",
        F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        F.col("arrival.item").alias("item"),
    )


TOKEN_FEEDS_SQL = f"""
WITH {REFRESH_INPUT_CTES},
b AS (SELECT NULL::VARCHAR AS token_key, * FROM shared UNION ALL SELECT * FROM own)
SELECT token_key, title, link, source, timestamp::BIGINT AS timestamp, tag,
       coalesce(given, 0e0) AS relevance, a_item::BIGINT AS item
FROM b
"""


def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search windows per token, with how many rows fall inside.

    Every document was seen by one token half a month ago and is found for another now.
    """
    doc = F.col("doc_id")
    docs = documents(spark, sf_dir).select("doc_id", "timestamp")
    previous = docs.select(
        _token_of(doc % 3).alias("token_key"), (F.col("timestamp") - 15 * DAY).alias("timestamp")
    )
    search = docs.select(_token_of(doc % 4).alias("token_key"), "timestamp")
    windows = search_windows(token_rows(spark), previous, as_of())
    inside = (
        within_window(search, windows)
        .groupBy("token_key")
        .agg(F.count(F.lit(1)).alias("n_inside"))
    )
    return windows.join(inside, "token_key", "left").withColumn(
        "n_inside", F.coalesce("n_inside", F.lit(0).cast("bigint"))
    )


HIGH_WATER_SQL = f"""
WITH docs AS ({sql.DOCUMENTS}),
windows AS (
    SELECT t.token_key, coalesce(max(p.timestamp) - {15 * DAY}, {AS_OF} - 2 * 365 * {DAY}) AS start_ts
    FROM ({sql.token_values()}) t LEFT JOIN docs p ON t.idx = p.doc_id % 3 GROUP BY t.token_key),
windowed AS (
    SELECT w.token_key FROM docs d JOIN ({sql.token_values()}) t ON t.idx = d.doc_id % 4
    JOIN windows w ON w.token_key = t.token_key
    WHERE make_timestamp(d.timestamp::BIGINT * 1000000)::DATE
          BETWEEN make_timestamp(w.start_ts::BIGINT * 1000000)::DATE
              AND make_timestamp({AS_OF}::BIGINT * 1000000)::DATE)
SELECT w.token_key, w.start_ts::BIGINT AS start_ts, {AS_OF}::BIGINT AS end_ts,
       (SELECT count(*) FROM windowed s WHERE s.token_key = w.token_key) AS n_inside
FROM windows w
"""


def _two_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    doc = F.col("doc_id")
    docs = documents(spark, sf_dir).withColumns(
        {
            "token_key": F.concat(F.lit("k"), (doc % 4).cast("string")),
            "link": F.when(doc % 9 > 0, F.col("link")),
        }
    )
    # every document is in one of them; k1 and k3 have no rows before
    before = docs.filter((doc % 2 == 0) & ((F.col("token_key") != "k2") | (doc % 3 == 0)))
    return docs.filter((doc % 3 > 0) | (doc % 2 == 1)), before


def only_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = _two_snapshots(spark, sf_dir)
    return new_articles(current, previous).select("token_key", "doc_id", "source", "link")


SNAPSHOT_CTES = f"""
d AS (SELECT * REPLACE (CASE WHEN doc_id % 9 > 0 THEN link END AS link), 'k' || (doc_id % 4) AS token_key
      FROM ({sql.DOCUMENTS})),
cur AS (SELECT * FROM d WHERE doc_id % 3 > 0 OR doc_id % 2 = 1),
prev AS (SELECT * FROM d WHERE doc_id % 2 = 0 AND (token_key <> 'k2' OR doc_id % 3 = 0))
"""
ONLY_NEW_SQL = f"""
WITH {SNAPSHOT_CTES}
SELECT token_key, doc_id, source, link FROM cur c
WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.token_key = c.token_key
    AND p.source IS NOT DISTINCT FROM c.source AND p.link IS NOT DISTINCT FROM c.link
    AND p.title IS NOT DISTINCT FROM c.title)
"""


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh_report(*_two_snapshots(spark, sf_dir))


REPORT_SQL = f"""
WITH {SNAPSHOT_CTES},
k AS (SELECT token_key, count(*) AS n FROM cur GROUP BY 1),
p AS (SELECT token_key, count(*) AS n FROM prev GROUP BY 1)
SELECT token_key, coalesce(k.n, 0) AS kept, coalesce(p.n, 0) AS previous,
       coalesce(k.n, 0) - coalesce(p.n, 0) AS added
FROM k FULL JOIN p USING (token_key)
"""


def filtered_and_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumns(
        {
            "relevance": F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 21) / 2),
            "utc_time": F.lit(None).cast("string"),
            "tag": F.lit("t"),
            "first_arrival": F.col("doc_id"),
        }
    )
    kept = filter_and_sort(docs, F.lit(6.5))
    return kept.select("title", "link", "source", "timestamp", "tag")


FILTER_SORT_SQL = f"""
SELECT title, link, source, timestamp, 't' AS tag FROM ({sql.DOCUMENTS})
WHERE CASE WHEN doc_id % 5 > 0 THEN (doc_id % 21) / 2e0 ELSE 0e0 END >= 6.5e0
ORDER BY timestamp DESC, doc_id
"""

# -- registry ----------------------------------------------------------------------

MIXED = "CASE WHEN {k} % 2 = 0 THEN upper({a}) ELSE {a} END"


def _address(key: Column) -> Column:
    """Forty hexadecimal digits; one key in eleven has no valid address."""
    good = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(key * 2654435761)), 40, "a"))
    return F.when(key % 11 == 3, F.lit("0xbad")).when(
        key % 13 == 5, F.lit(NATIVE_ADDRESS.upper().replace("0X", "0x"))
    ).otherwise(good)


def _networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("network"), F.col("n_nationkey").cast("bigint").alias("chain_id")
    )


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as listed tokens; every seventh is listed twice, in capitals."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        key.alias("pos"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("network"),
        _address(key).alias("address"),
        F.concat(F.lit("L"), key.cast("string")).alias("symbol"),
    )
    again = rows.filter(F.col("pos") % 7 == 0).withColumns(
        {
            "pos": F.col("pos") + 1_000_000_000,
            "address": F.concat(F.lit("0x"), F.upper(F.substring("address", 3, 40))),
        }
    )
    return rows.unionByName(again)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers are registered already, on their network."""
    key = F.col("c_custkey")
    values = {
        "name": F.col("c_name"),
        "symbol": F.concat(F.lit("S"), key.cast("string")),
        "address": F.create_map(
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")), _address(key)
        ),
        "lookback_years": F.lit(2),
        "relevance_threshold": F.lit(None),
        "mandatory_phrases": F.array(),
        "additional_phrases": F.array(F.lit("defi")),
        "rss_feeds": F.lit(None),
    }
    rows = table(spark, sf_dir, "customer").filter((key % 2 == 0) & (key % 13 != 5))
    return rows.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in TOKEN))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .filter(key % 5 > 0)
        .select(
            F.col("c_nationkey").cast("bigint").alias("chain_id"),
            F.concat(F.lit("0x"), F.upper(F.substring(_address(key), 3, 40))).alias("address"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("S"), key.cast("string")).alias("symbol"),
        )
    )


def _refreshed(spark: SparkSession, sf_dir: str) -> RegistryRefresh:
    return refresh_registry(
        _networks(spark, sf_dir),
        _candidates(spark, sf_dir),
        _metadata(spark, sf_dir),
        _registry(spark, sf_dir),
        order="pos",
    )


def _sql_address(key: str) -> str:
    return (
        f"CASE WHEN {key} % 11 = 3 THEN '0xbad' "
        f"WHEN {key} % 13 = 5 THEN {q(NATIVE_ADDRESS.upper().replace('0X', '0x'))} "
        f"ELSE '0x' || lpad(lower(to_hex({key}::BIGINT * 2654435761)), 40, 'a') END"
    )


REGISTRY_CTES = f"""
rows AS (SELECT c_custkey AS pos, 'NATION_' || c_nationkey AS network, {_sql_address('c_custkey')} AS address,
                'L' || c_custkey AS symbol, c_name, c_nationkey::BIGINT AS nk FROM customer),
cand AS (SELECT pos, network, address, symbol FROM rows
         UNION ALL SELECT pos + 1000000000, network, '0x' || upper(substring(address, 3, 40)), symbol
         FROM rows WHERE pos % 7 = 0),
reg AS (SELECT c_name AS name, 'S' || pos AS symbol, network, address FROM rows
        WHERE pos % 2 = 0 AND pos % 13 <> 5),
meta AS (SELECT nk AS chain_id, lower(address) AS ak, min(struct_pack(n := c_name, s := 'S' || pos)) AS m
         FROM rows WHERE pos % 5 > 0 GROUP BY 1, 2),
listed AS (SELECT c.*, n_nationkey::BIGINT AS chain_id FROM cand c JOIN nation ON n_name = network
           WHERE lower(address) <> {q(NATIVE_ADDRESS.lower())}),
fresh AS (SELECT * FROM listed l
          WHERE NOT EXISTS (SELECT 1 FROM reg r WHERE r.network = l.network AND lower(r.address) = lower(l.address))
          QUALIFY row_number() OVER (PARTITION BY network, lower(address) ORDER BY pos) = 1),
looked AS (SELECT f.*, m.n AS name, m.s AS new_symbol
           FROM fresh f LEFT JOIN meta ON meta.chain_id = f.chain_id AND ak = lower(f.address)
                AND regexp_matches(f.address, '^0x[0-9a-fA-F]{{40}}$'))
"""


def native_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_native(_candidates(spark, sf_dir))


def registry_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = drop_native(_candidates(spark, sf_dir))
    return new_candidates(listed, _registry(spark, sf_dir), order="pos")


def _flat(tokens: DataFrame) -> DataFrame:
    entry = F.map_entries("address")[0]
    return tokens.select(
        "name", "symbol", entry["key"].alias("network"), entry["value"].alias("address"),
        F.col("lookback_years").cast("bigint").alias("lookback_years"),
        F.array_join("additional_phrases", "|").alias("phrases"),
        F.size("mandatory_phrases").cast("bigint").alias("n_mandatory"),
    )


def registry_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_refreshed(spark, sf_dir).registry)


def registry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir).failed.select("network", "chain_id", "address", "symbol")


def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir).report.withColumn(
        "network", F.coalesce("network", F.lit("all"))
    )


NATIVE_SQL = f"WITH {REGISTRY_CTES} SELECT * FROM cand WHERE lower(address) <> {q(NATIVE_ADDRESS.lower())}"
REGISTRY_NEW_SQL = f"WITH {REGISTRY_CTES} SELECT network, pos, address, symbol FROM fresh"
REGISTRY_REFRESH_SQL = f"""
WITH {REGISTRY_CTES},
u AS (SELECT name, symbol, network, address FROM reg
      UNION ALL SELECT name, new_symbol, network, address FROM looked WHERE name IS NOT NULL)
SELECT *, 2::BIGINT AS lookback_years, 'defi' AS phrases, 0::BIGINT AS n_mandatory FROM u
"""
REGISTRY_FAILED_SQL = (
    f"WITH {REGISTRY_CTES} SELECT network, chain_id, address, symbol FROM looked WHERE name IS NULL"
)
REGISTRY_COUNTS_SQL = f"""
WITH {REGISTRY_CTES},
n AS (SELECT network FROM looked WHERE name IS NOT NULL),
u AS (SELECT network, 0 AS fresh FROM reg UNION ALL SELECT network, 1 FROM n)
SELECT network, count(*) AS total_tokens, sum(fresh)::BIGINT AS new_tokens FROM u GROUP BY 1
UNION ALL SELECT 'all', count(*), sum(fresh)::BIGINT FROM u
"""

# -- chains ------------------------------------------------------------------------


def chain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers looked up by chain id and by name; some of both are unknown."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("bigint")
    # nations 20 and up repeat an earlier name: the first entry wins
    chains = nation.select(
        key.alias("pos"),
        key.alias("chain_id"),
        F.concat(F.lit("Chain_"), (key % 20).cast("string")).alias("chain_name"),
    )
    url = F.concat(F.lit("https://rpc"), key.cast("string"))
    rpcs = nation.filter(key % 3 > 0).select(
        key.alias("pos"),
        key.alias("chainId"),
        F.transform(
            F.sequence(F.lit(1), (key % 3).cast("int")),
            lambda i: F.struct(F.concat(url, F.lit("/"), i.cast("string")).alias("url")),
        ).alias("rpc"),
    )
    cust = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        (F.col("c_nationkey") + F.when(cust % 10 == 0, 100).otherwise(0))
        .cast("bigint")
        .alias("chain_id"),
        F.concat(F.lit("CHAIN_"), (cust % 23).cast("string")).alias("wanted"),
    )
    by_id = with_rpc_urls(with_chain_name(rows, chains), rpcs).withColumnRenamed(
        "chain_id", "asked_id"
    )
    return with_chain_id(by_id, chains, "wanted").select(
        "c_custkey", "asked_id", "chain_name", "wanted",
        F.coalesce("chain_id", F.lit(-1)).alias("found_id"),
        F.array_join("urls", " ").alias("urls"),
    )


CHAIN_SQL = """
WITH ch AS (SELECT n_nationkey::BIGINT AS id, 'Chain_' || (n_nationkey % 20) AS name FROM nation),
rpc AS (SELECT id, array_to_string(list_transform(range(1, id % 3 + 1),
               lambda i: 'https://rpc' || id || '/' || i), ' ') AS urls FROM ch WHERE id % 3 > 0),
r AS (SELECT c_custkey, (c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END)::BIGINT AS asked_id,
             'CHAIN_' || (c_custkey % 23) AS wanted FROM customer),
f AS (SELECT lower(name) AS l, min(id) AS id FROM ch GROUP BY 1)
SELECT c_custkey, asked_id, ch.name AS chain_name, wanted, coalesce(f.id, -1)::BIGINT AS found_id,
       coalesce(rpc.urls, '') AS urls
FROM r LEFT JOIN ch ON ch.id = asked_id LEFT JOIN rpc ON rpc.id = asked_id
       LEFT JOIN f ON f.l = lower(wanted)
"""

# -- landed files ------------------------------------------------------------------


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search result per planned query, given to every token that asked it."""
    tokens = part_tokens(spark, sf_dir)
    queries = landed.planned_queries(tokens).select("query_id", "query").distinct()
    zero = F.lit(0).cast("bigint")
    results = queries.select("query_id", F.col("query").alias("title"), zero.alias("page"), zero.alias("item"))
    return landed.token_search_articles(results, tokens).select(
        "token_key", "title", F.col("arrival.list").alias("query_order")
    )


SEARCH_ROWS_SQL = f"SELECT token_key, query AS title, query_order FROM ({QUERY_PLAN_SQL})"


def _landed_registry(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Networks, candidates and metadata as the files that a registry run reads."""
    root = shared_folder(configure(spark), "registry")
    networks = _networks(spark, sf_dir).agg(
        F.map_from_entries(F.collect_list(F.struct("network", "chain_id"))).alias("platformToChainIdMap")
    )
    networks.select(F.struct("platformToChainIdMap").alias("data")).write.json(f"{root}/networks")
    listed = _candidates(spark, sf_dir).groupBy("network", (F.col("pos") % 50).alias("file"))
    files = listed.agg(F.collect_list(F.struct("address", "symbol")).alias("tokens"))
    files.select("network", F.struct("tokens").alias("data")).write.partitionBy("network").option(
        "maxRecordsPerFile", 1
    ).json(f"{root}/coins")
    _metadata(spark, sf_dir).write.json(f"{root}/metadata")
    write_registry(_registry(spark, sf_dir), f"{root}/registry", 1)
    return {
        "networks_path": f"{root}/networks", "candidates_path": f"{root}/coins",
        "metadata_path": f"{root}/metadata", "registry_root": f"{root}/registry",
    }


def registry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry that a run over landed files writes."""
    paths = _landed_registry(spark, sf_dir)
    run_registry(spark, as_of=2, **paths)
    return _flat(read_registry(spark, paths["registry_root"]))


# a run takes the first of equal addresses by letters, capitals first
REGISTRY_RUN_SQL = REGISTRY_REFRESH_SQL.replace("lower(address) ORDER BY pos", "lower(address) ORDER BY address, symbol")


def listed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the tokens of settings files, up to 100 in each, all read in one job."""
    path = f"{shared_folder(configure(spark), 'settings')}"
    key = F.col("s_suppkey")
    entry = F.struct(
        F.col("s_name").alias("name"), F.concat(F.lit("S"), key.cast("string")).alias("symbol"),
        F.create_map(F.lit("chain"), key.cast("string")).alias("address"),
        F.when(key % 2 == 0, 7.25).alias("relevance_threshold"),
    )
    files = table(spark, sf_dir, "supplier").groupBy(F.floor(key / 100).alias("file")).agg(F.collect_list(entry).alias("tokens"))
    body = files.select("file", F.to_json(F.struct(F.lit(7.5).alias("default_relevance_threshold"), "tokens")).alias("value"))
    body.write.partitionBy("file").text(path)
    tokens = prepare_tokens(read_listed_tokens(spark, path), Settings())
    return tokens.select("name", "symbol", "threshold", F.col("lookback_years").cast("bigint").alias("lookback_years"))


LISTED_TOKENS_SQL = """
SELECT s_name AS name, 'S' || s_suppkey AS symbol, CASE WHEN s_suppkey % 2 = 0 THEN 7.25e0 ELSE 7.5e0 END AS threshold,
       2::BIGINT AS lookback_years
FROM supplier
"""


def chain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain names and endpoints as the files that are downloaded, read back."""
    root = shared_folder(configure(spark), "chains")
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    entries = F.array_sort(F.collect_list(F.struct(key.alias("id"), F.col("n_name").alias("name"))))
    names = nation.agg(entries.alias("e")).select(
        F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["id"].cast("string"), x["name"])))).alias("value")
    )
    names.write.text(f"{root}/names")
    rpc = F.struct(
        key.cast("bigint").alias("chainId"),
        F.array(F.struct(F.concat(F.lit("https://rpc"), key.cast("string")).alias("url"))).alias("rpc"),
    )
    nation.agg(F.to_json(F.array_sort(F.collect_list(rpc))).alias("value")).write.text(f"{root}/rpcs")
    chains = landed.read_chain_names(spark, f"{root}/names")
    rpcs = landed.read_chain_rpcs(spark, f"{root}/rpcs").withColumnRenamed("pos", "rpc_pos")
    return chains.join(rpcs, F.col("chain_id") == F.col("chainId")).select(
        "chain_id", "chain_name", F.col("pos").cast("bigint").alias("pos"),
        F.col("rpc_pos").cast("bigint").alias("rpc_pos"), F.col("rpc")[0]["url"].alias("url"),
    )


CHAIN_FILES_SQL = """
SELECT n_nationkey::BIGINT AS chain_id, n_name AS chain_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos,
       row_number() OVER (ORDER BY n_nationkey) - 1 AS rpc_pos, 'https://rpc' || n_nationkey AS url
FROM nation
"""

QUERIES = {
    "search_rows": (search_rows, SEARCH_ROWS_SQL),
    "registry_run": (registry_run, REGISTRY_RUN_SQL),
    "listed_tokens": (listed_tokens, LISTED_TOKENS_SQL),
    "chain_files": (chain_files, CHAIN_FILES_SQL),
    "query_plan": (planned_queries, QUERY_PLAN_SQL),
    "token_registry": (token_registry, TOKEN_REGISTRY_SQL),
    "token_feed_articles": (token_feeds, TOKEN_FEEDS_SQL),
    "high_water_mark": (high_water_mark, HIGH_WATER_SQL),
    "new_articles": (only_new, ONLY_NEW_SQL),
    "refresh_report": (report, REPORT_SQL),
    "filter_and_sort": (filtered_and_sorted, FILTER_SORT_SQL),
    "native_filter": (native_filter, NATIVE_SQL),
    "registry_new": (registry_new, REGISTRY_NEW_SQL),
    "registry_refresh": (registry_refresh, REGISTRY_REFRESH_SQL),
    "registry_failed": (registry_failed, REGISTRY_FAILED_SQL),
    "registry_report": (registry_counts, REGISTRY_COUNTS_SQL),
    "chain_lookup": (chain_lookup, CHAIN_SQL),
}

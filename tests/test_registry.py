from pyspark.sql import functions as F

from newsweave.functions.wordlists import NATIVE_ADDRESS
from newsweave.operators.chains import with_chain_id, with_chain_name, with_rpc_urls
from newsweave.plans.registry import refresh_registry
from newsweave.schemas import CHAIN_RPCS, TOKEN, TOKEN_METADATA

A, B, C, D = ("0x" + c * 40 for c in "abcd")


def test_registry_refresh(spark):
    networks = spark.createDataFrame([("eth", 1), ("bsc", 56)], "network string, chain_id bigint")
    candidates = spark.createDataFrame(
        [
            (0, "eth", A.upper().replace("0X", "0x"), "a"),  # registered, other letter case
            (1, "bsc", A, "a"),  # same address, other network: new
            (2, "eth", NATIVE_ADDRESS.lower(), "ETH"),
            (3, "eth", B, "listed"),
            (4, "eth", B.upper().replace("0X", "0x"), "again"),
            (5, "eth", "0x12", "malformed"),
            (6, "eth", C, "no metadata"),
            (7, "moon", D, "unknown network"),
        ],
        "pos int, network string, address string, symbol string",
    )
    metadata = spark.createDataFrame(
        [(1, B.upper().replace("0X", "0x"), "Bee", "BEE"), (56, A, "Ay", "AY"), (1, "0x12", "Bad", "BAD")],
        TOKEN_METADATA,
    )
    registry = spark.createDataFrame(
        [("Ay", "AY", {"eth": A}, 2, None, [], ["defi"], None)], TOKEN
    )
    done = refresh_registry(networks, candidates, metadata, registry, order="pos")
    new = {(r.name, r.symbol, tuple(r.address.items())) for r in done.new_tokens.collect()}
    assert new == {("Bee", "BEE", (("eth", B),)), ("Ay", "AY", (("bsc", A),))}
    row = done.new_tokens.first()
    assert (row.lookback_years, row.relevance_threshold) == (2, None)
    assert (row.mandatory_phrases, row.additional_phrases) == ([], ["defi"])
    assert {r.symbol for r in done.failed.collect()} == {"malformed", "no metadata"}
    assert done.registry.schema == TOKEN and done.registry.count() == 3
    counts = {r.network: (r.total_tokens, r.new_tokens) for r in done.report.collect()}
    assert counts == {"eth": (2, 1), "bsc": (1, 1), None: (3, 2)}
    # a second run finds nothing new
    again = refresh_registry(networks, candidates, metadata, done.registry, order="pos")
    assert again.new_tokens.count() == 0


def test_chain_lookups(spark):
    chains = spark.createDataFrame(
        [(0, 1, "Ethereum"), (1, 56, "bsc"), (2, 99, "ETHEREUM")],
        "pos int, chain_id bigint, chain_name string",
    )
    rows = spark.createDataFrame([(1, "eTHEREUM"), (99, "BSC"), (7, "mars")], "chain_id bigint, wanted string")
    names = {r.chain_id: r.chain_name for r in with_chain_name(rows, chains).collect()}
    assert names == {1: "Ethereum", 99: "ETHEREUM", 7: None}
    ids = {r.wanted: r.chain_id for r in with_chain_id(rows.drop("chain_id"), chains, "wanted").collect()}
    assert ids == {"eTHEREUM": 1, "BSC": 56, "mars": None}
    rpcs = spark.createDataFrame(
        [(1, [("u1",), ("u2",)]), (1, [("late",)]), (99, None)], CHAIN_RPCS
    ).withColumn("pos", F.monotonically_increasing_id())
    urls = {r.chain_id: r.urls for r in with_rpc_urls(rows, rpcs).collect()}
    assert urls == {1: ["u1", "u2"], 99: [], 7: []}

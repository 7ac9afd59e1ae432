"""Registered queries over symbol resolution and audits: raw symbols are derived from orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.safe import rounded, seconds
from barloom.plans.market import FEATURES, ROOTS, features
from barloom.sources import ingest as S
from barloom.sources.stage import staged_path
from barloom.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def raw(spark, d) -> DataFrame:
    """Rows like raw minute bars: 60 instruments, symbols with spreads among them."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    iid = k % 60
    sym = F.concat(at(S.ROOTS, iid % 3), at(list(S.MONTHS), iid % 4), (iid % 10).cast("string"))
    return o.select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts_event"), iid.alias("instrument_id"), F.when(k % 11 == 0, F.concat(sym, F.lit("-X"))).otherwise(sym).alias("symbol"), F.col("o_totalprice").alias("close"), k.alias("file_row"))


def outrights(spark, d) -> DataFrame:
    return raw(spark, d).filter(S.is_outright())


RAWSQL = """WITH k AS (SELECT o_orderdate AS ts_event, o_orderkey % 60 AS instrument_id, o_totalprice AS close, o_orderkey AS file_row FROM orders),
k2 AS (SELECT *, ['ES', 'NQ', 'RTY'][instrument_id % 3 + 1] || ['H', 'M', 'U', 'Z'][instrument_id % 4 + 1] || (instrument_id % 10)::VARCHAR AS sym FROM k),
raw AS (SELECT *, CASE WHEN file_row % 11 = 0 THEN sym || '-X' ELSE sym END AS symbol FROM k2),
outr AS (SELECT * FROM raw WHERE regexp_matches(symbol, '^(ES|NQ|RTY)[HMUZ][0-9]$')),
ins AS (SELECT instrument_id, arg_min(symbol, ts_event) AS raw_symbol, year(min(ts_event)) AS a, year(max(ts_event)) AS b FROM outr GROUP BY ALL),
ins2 AS (SELECT *, right(raw_symbol, 1)::INT AS dg, (a + b) / 2 AS mid, left(raw_symbol, len(raw_symbol) - 2) AS contract_root, substr(raw_symbol, len(raw_symbol) - 1, 1) AS code FROM ins),
ins3 AS (SELECT *, CASE WHEN abs(2010 + dg - mid) <= abs(2020 + dg - mid) THEN 2010 + dg ELSE 2020 + dg END AS y, CASE code WHEN 'H' THEN 3 WHEN 'M' THEN 6 WHEN 'U' THEN 9 ELSE 12 END AS m FROM ins2),
ins4 AS (SELECT *, make_date(y, m, 1) AS m1 FROM ins3), ins5 AS (SELECT *, contract_root || code || y::VARCHAR AS symbol, m1 + ((5 - isodow(m1) + 7) % 7 + 14)::INT AS expiry FROM ins4)"""


@query("s12_s17_instruments", RAWSQL + " SELECT instrument_id, raw_symbol, symbol, contract_root, expiry::DATE::VARCHAR AS expiry_date FROM ins5")
def s14(spark, d):
    return S.instruments(outrights(spark, d)).withColumn("expiry_date", F.col("expiry_date").cast("string"))


@query("s15_contract_year_window", RAWSQL + " SELECT instrument_id, contract_root || code || (CASE WHEN 2010 + dg BETWEEN a - 1 AND b + 1 THEN 2010 + dg WHEN 2020 + dg BETWEEN a - 1 AND b + 1 THEN 2020 + dg ELSE y END)::VARCHAR AS symbol FROM ins5")
def s15(spark, d):
    return S.instruments(outrights(spark, d), True).select("instrument_id", "symbol")


@query("s10_s11_typed_rows", "SELECT o_orderkey AS k, epoch(o_orderdate)::BIGINT AS t FROM orders WHERE o_orderkey % 7 <> 0")
def s10(spark, d):
    """Four ways to write a time: with nanoseconds and Z, with Z, without a zone, and with another zone's offset."""
    k = F.col("o_orderkey")
    text = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    forms = F.when(k % 4 == 0, F.concat(text(at), F.lit(".123456789Z"))).when(k % 4 == 1, F.concat(text(at), F.lit("Z"))).when(k % 4 == 2, text(at)).otherwise(F.concat(text(at + F.expr("INTERVAL 2 HOUR")), F.lit("+02:00")))
    o = read(spark, d, "orders").select(k, F.when(k % 7 == 0, F.lit("x")).otherwise(k.cast("string")).alias("instrument_id"), forms.alias("s"))
    o = S.typed_ids(o, False)
    return o.select(F.col("instrument_id").alias("k"), F.unix_seconds(S.utc_timestamp("s")).alias("t"))


@query(
    "s1_s9_round_trips",
    RAWSQL + """, ty AS (SELECT o.*, i.contract_root FROM outr o JOIN ins5 i USING (instrument_id)), al AS (SELECT count(*) AS n, round(sum(close), 2) AS total FROM raw), tn AS (SELECT count(*) AS n, round(sum(close), 2) AS total FROM ty), rs AS (SELECT count(*) AS n, round(sum(s), 2) AS total FROM (SELECT contract_root, sum(close) AS s FROM ty GROUP BY contract_root))
SELECT 'csv scan' AS what, * FROM al UNION ALL SELECT 'csv pruned', * FROM al UNION ALL SELECT 'typed parquet', * FROM tn UNION ALL SELECT 'read through', * FROM tn UNION ALL SELECT 'result csv', * FROM rs UNION ALL SELECT 'result json', * FROM rs UNION ALL SELECT 'result parquet', * FROM rs""",
)
def s1(spark, d):
    """Every source and sink once: what is written is read again and summed."""
    at = staged_path(spark)
    wide = raw(spark, d).select(F.date_format("ts_event", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts_event"), F.lit(33).alias("rtype"), F.lit(1).alias("publisher_id"), F.col("instrument_id").cast("string").alias("instrument_id"), *[F.col("close").cast("double").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).alias("volume"), "symbol")
    S.write_results(wide, f"{at}/csv", "csv")
    whole = S.scan_csv(spark, f"{at}/csv/*.csv")
    rows = S.typed_ids(whole).withColumn("ts_event", S.utc_timestamp("ts_event")).filter(S.is_outright())
    S.write_typed(S.resolved(rows), f"{at}/typed")
    typed = S.scan_parquet(spark, f"{at}/typed", "symbol", "close", "contract_root")
    kept = S.read_through(spark, f"{at}/kept", lambda: typed)
    kept = S.read_through(spark, f"{at}/kept", lambda: typed.limit(0))  # the second call reads what the first wrote
    per = typed.groupBy("contract_root").agg(F.sum("close").alias("close"))
    out = {"csv scan": whole, "csv pruned": S.scan_csv(spark, f"{at}/csv/*.csv", "close"), "typed parquet": typed, "read through": kept}
    for form in ("csv", "json", "parquet"):
        S.write_results(per, f"{at}/{form}-result", form)
        back = spark.read.option("header", True).format(form).load(f"{at}/{form}-result")
        out[f"result {form}"] = back.withColumn("close", F.col("close").cast("double"))
    each = [df.agg(F.lit(name).alias("what"), F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total")) for name, df in out.items()]
    return reduce(DataFrame.unionByName, each)


@query("s17_resolved", RAWSQL + " SELECT i.symbol, i.contract_root, count(*) AS n, round(sum(close), 2) AS total FROM outr o JOIN ins5 i USING (instrument_id) GROUP BY ALL")
def s17(spark, d):
    return rounded(S.resolved(outrights(spark, d)).groupBy("symbol", "contract_root").agg(F.count("*").alias("n"), F.sum("close").alias("total")), 2)


@query("q1_symbol_inventory", RAWSQL + " SELECT left(symbol, len(symbol) - 2) AS contract_root, symbol, epoch(min(ts_event))::BIGINT AS first_t, epoch(max(ts_event))::BIGINT AS last_t, count(*) AS n FROM outr GROUP BY ALL")
def q1(spark, d):
    return S.symbol_inventory(outrights(spark, d)).select("contract_root", "symbol", seconds("first_ts").alias("first_t"), seconds("last_ts").alias("last_t"), "n")


@query("q2_top_rejected", RAWSQL + " SELECT symbol, count(*) AS count FROM raw WHERE NOT regexp_matches(symbol, '^(ES|NQ|RTY)[HMUZ][0-9]$') GROUP BY symbol ORDER BY count DESC, symbol LIMIT 20")
def q2(spark, d):
    return S.top_rejected(raw(spark, d))


@query("q3_q4_expiry_flags", RAWSQL + ", n AS (SELECT instrument_id, max(ts_event) AS l, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM outr GROUP BY ALL) SELECT instrument_id, symbol, n, n_symbols, l::DATE > expiry::DATE + 7 AS late, n <= 10 AS few, l::DATE > expiry::DATE + 2 AND n > 1000 AS busy_after, n_symbols > 1 AS many_symbols FROM n JOIN ins5 USING (instrument_id)")
def q3(spark, d):
    return S.expiry_flags(outrights(spark, d))


@query("q4_ids_per_root", RAWSQL + " SELECT left(symbol, len(symbol) - 2) AS contract_root, count(DISTINCT instrument_id) AS n_ids, count(DISTINCT symbol) AS n_symbols FROM outr GROUP BY ALL")
def q4(spark, d):
    return S.ids_per_root(outrights(spark, d))


@query("q5_drill_down", RAWSQL + " SELECT instrument_id, epoch(min(ts_event))::BIGINT AS first_t, epoch(max(ts_event))::BIGINT AS last_t, count(*) AS n FROM outr WHERE symbol = 'ESH0' GROUP BY instrument_id")
def q5(spark, d):
    return S.drill_down(outrights(spark, d), "ESH0").select("instrument_id", seconds("first_ts").alias("first_t"), seconds("last_ts").alias("last_t"), "n")


@query(
    "q6_schema_check",
    RAWSQL + """, w AS (SELECT count(*) AS n, count(ts_event) AS ts_event, count(i.instrument_id) AS instrument_id, count(close) AS close, count(i.symbol) AS symbol, count(contract_root) AS contract_root, count(expiry) AS expiry_date FROM outr o JOIN ins5 i USING (instrument_id)),
e(place, name, type) AS (VALUES (0, 'ts_event', 'timestamp'), (1, 'rtype', 'bigint'), (2, 'publisher_id', 'bigint'), (3, 'instrument_id', 'bigint'), (4, 'open', 'double'), (5, 'high', 'double'), (6, 'low', 'double'), (7, 'close', 'double'), (8, 'volume', 'bigint'), (9, 'symbol', 'string'), (10, 'contract_root', 'string'), (11, 'expiry_date', 'date'))
SELECT place, name, type, false AS agrees, CASE name WHEN 'ts_event' THEN ts_event WHEN 'instrument_id' THEN instrument_id WHEN 'close' THEN close WHEN 'symbol' THEN symbol WHEN 'contract_root' THEN contract_root WHEN 'expiry_date' THEN expiry_date ELSE 0 END AS known, n FROM e, w""",
)
def q6(spark, d):
    return S.schema_check(S.resolved(outrights(spark, d)))


@query("q7_duplicate_keys", RAWSQL + " SELECT instrument_id, epoch(ts_event)::BIGINT AS t, count(*) AS count FROM raw GROUP BY ALL HAVING count(*) > 1")
def q7(spark, d):
    return S.duplicate_keys(raw(spark, d).withColumn("t", seconds("ts_event")), "instrument_id", "t")


@query("q8_inversions", RAWSQL + ", l AS (SELECT instrument_id, ts_event < lag(ts_event) OVER (PARTITION BY instrument_id ORDER BY file_row) AS back FROM raw) SELECT instrument_id, count(*) FILTER (back) AS inversions FROM l GROUP BY ALL")
def q8(spark, d):
    return S.inversions(raw(spark, d), "instrument_id", "ts_event", "file_row")


@query("q9_one_to_one", RAWSQL + " SELECT instrument_id, count(DISTINCT symbol) AS n FROM raw GROUP BY ALL HAVING count(DISTINCT symbol) > 1")
def q9(spark, d):
    return S.one_to_one(raw(spark, d), "instrument_id", "symbol")


@query("q10_round_trip", RAWSQL + " SELECT file_row, close AS close_a, CASE WHEN file_row % 100 <> 0 THEN close + 1 END AS close_b FROM raw WHERE file_row % 50 = 0")
def q10(spark, d):
    a = raw(spark, d).select("file_row", "close")
    b = a.filter("file_row % 100 <> 0").withColumn("close", F.when(F.col("file_row") % 50 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return S.round_trip(a, b, ["file_row"], ["close"])


@query("q11_counts", RAWSQL + " SELECT count(*) AS n, count(DISTINCT instrument_id) AS ids FROM raw")
def q11(spark, d):
    return S.counts(raw(spark, d), "instrument_id")


def _profile(c: str, kind: str) -> str:
    return f"SELECT '{c}' AS name, '{kind}' AS type, count({c}) AS known, count(DISTINCT {c}) AS \"unique\", min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest, arg_min({c}, file_row)::VARCHAR AS head, arg_max({c}, file_row)::VARCHAR AS tail FROM raw"


@query("q12_profile", RAWSQL + " " + _profile("symbol", "string") + " UNION ALL " + _profile("instrument_id", "bigint"))
def q12(spark, d):
    return S.profile(raw(spark, d).withColumn("instrument_id", F.col("instrument_id").cast("long")), ["symbol", "instrument_id"], "file_row")


@query("q13_retention", FEATURES + " SELECT root, count(*) AS total, count(*) FILTER (ok) AS valid, count(*) - count(*) FILTER (ok) AS excluded, round(count(*) FILTER (ok) / count(*), 6) AS share FROM fe GROUP BY root")
def q13(spark, d):
    return rounded(S.retention(features(spark, d), F.col("is_valid_bar")))


@query("q14_window_counts", FEATURES + " SELECT root, count(*) AS n_total, count(*) FILTER (ok) AS n_valid, count(*) FILTER (train) AS n_train, 300::INT AS middle, round((count(*) FILTER (train) - 300) * 100.0 / 300, 6) + 0 AS deviation_pct, abs((count(*) FILTER (train) - 300) * 100.0 / 300) > 20 AS flagged FROM fe GROUP BY root")
def q14(spark, d):
    return rounded(S.window_counts(features(spark, d), spark.createDataFrame([(r, 300) for r in ROOTS], "root string, middle int")))

"""The registered queries: every operator, run over the whole test tables.

``QUERIES`` maps a name to a function of a session and a folder of Parquet tables; ``ORACLE`` maps it to the
same result in the SQL of an independent engine. Results without an oracle are said so in the README.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions import columns as C
from tablework.functions import rows as R
from tablework.functions import vectors as V
from tablework.operators import changes as CH
from tablework.operators import search as S
from tablework.operators import tables as TB
from tablework.operators import textindex as X
from tablework.operators.skew import salted_join
from tablework.operators.timejoin import asof_join, range_join
from tablework.plans import catalog, loads, models
from tablework.schemas import ENTITY_SCHEMA, LOAD_TIME_COLUMN, NA_TOKENS
from tablework.session import fresh_path, ship, stage
from tablework.sources import archives, bulkcsv, files, pages, records
from tablework.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship(spark)
            return function(spark, folder)

        QUERIES[function.__name__] = run
        if oracle is not None:
            ORACLE[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return files.read_parquet(spark, f"{folder.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy on the processor. Input of fewer splits than there are cores is small, and is
    dealt out to all of them; larger input is left as it is."""
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---- an entity table, derived from customer; one text for both engines -------------------------------

ENTITIES = """
SELECT concat('L', CAST(c_custkey AS STRING)) AS lei, c_name AS legal_name, c_mktsegment AS legal_form,
  CASE c_nationkey % 7 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'JP' WHEN 3 THEN 'GB'
       WHEN 4 THEN '' WHEN 5 THEN CAST(NULL AS STRING) ELSE 'NA' END AS country,
  concat('J', CAST(c_nationkey AS STRING)) AS jurisdiction,
  CASE WHEN c_acctbal >= 0 THEN 'ACTIVE' ELSE 'LAPSED' END AS status,
  CASE WHEN c_custkey % 13 = 5 THEN CAST(NULL AS STRING)
       WHEN c_custkey % 4 = 0 OR c_custkey % 10 = 1 OR c_custkey < 97 THEN ''
       WHEN c_custkey % 11 = 3 THEN 'L-missing'
       ELSE concat('L', CAST(c_custkey % 97 AS STRING)) END AS direct_parent_lei,
  CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey < 97 THEN concat('L', CAST(c_custkey AS STRING))
       WHEN c_custkey % 5 = 0 THEN '' ELSE concat('L', CAST(c_custkey % 7 AS STRING)) END AS ultimate_parent_lei
FROM """

ENT = f"WITH ent AS ({ENTITIES} customer) "
NA_LIST = ", ".join(f"'{t}'" for t in NA_TOKENS)


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(ENTITIES + "{customer}", customer=table(spark, folder, "customer"))


# ---- sources ---------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def scan_parquet(spark, folder):
    df = files.read_file(spark, f"{folder}/part.parquet")
    return df.select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, folder):
    path = fresh_path(spark, "customer") + ".csv"
    table(spark, folder, "customer").write.option("header", True).csv(path)
    return files.read_file(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def scan_json(spark, folder):
    path = fresh_path(spark, "events") + ".json"
    table(spark, folder, "events").write.json(path)
    return files.read_file(spark, path).select("event_id", "user_id", "event_type", "value", "props")


@query(
    ENT
    + f"""SELECT lei, legal_name, CASE WHEN country IS NULL OR country IN ({NA_LIST}) THEN '' ELSE country END
    AS country, coalesce(direct_parent_lei, '') AS direct_parent_lei FROM ent"""
)
def bulk_text(spark, folder):
    path = fresh_path(spark, "bulk")
    chosen = entities(spark, folder).select("lei", "legal_name", "country", "direct_parent_lei")
    chosen.write.option("header", True).csv(path)
    return bulkcsv.clean_text(bulkcsv.read_text_csv(spark, path))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def bulk_load(spark, folder):
    path, target = fresh_path(spark, "bulk"), fresh_path(spark, "bulk_table")
    table(spark, folder, "orders").write.option("header", True).csv(path)
    name = target.rsplit("/", 1)[1].replace("-", "_")
    bulkcsv.load_bulk(spark, path, name, location=target)
    return (
        spark.table(name).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    )


MESSY = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 7 = 2 THEN '' ELSE md5(replace(text, chr(13), '')) END
    AS text_md5, CASE WHEN doc_id % 7 IN (2, 3) THEN '' ELSE lang END AS lang FROM documents
    WHERE doc_id % 7 NOT IN (4, 5)"""


def messy_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as CSV records with quotes and line breaks; some too short, some too long, some with their long rest
    beginning empty."""
    text = F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit('"'), F.lit('""'))
    field = F.concat(F.lit('"'), text, F.lit('"'))
    number, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 7
    whole = F.concat_ws(",", number, field, "lang")
    return table(spark, folder, "documents").select(
        F.when(kind == 2, number)
        .when(kind == 3, F.concat_ws(",", number, field))
        .when(kind == 4, F.concat(whole, F.lit(",extra")))
        .when(kind == 5, F.concat(whole, F.lit(",,z")))
        .otherwise(whole)
        .alias("value")
    )


def digested(rows: DataFrame) -> DataFrame:
    cleaned = bulkcsv.clean_text(rows, na_tokens=())
    digest = F.when(F.col("text") == "", "").otherwise(F.md5("text"))
    return cleaned.select("doc_id", digest.alias("text_md5"), "lang")


@query(MESSY)
def bulk_messy(spark, folder):
    path = fresh_path(spark, "messy")

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["doc_id,text,lang"]})
        yield from batches

    messy_records(spark, folder).mapInPandas(headed, "value string").write.text(path)
    return digested(bulkcsv.read_text_csv(spark, path))


@query(MESSY)
def archive_rows(spark, folder):
    """The same records through landed archives, written by the tasks to the shared folder."""

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("documents.csv", "\n".join(["doc_id,text,lang", *batch["value"]]) + "\n")
            yield pd.DataFrame({"path": [f"{hash(batch['value'].iloc[0])}.zip"], "content": [buffer.getvalue()]})

    made = messy_records(spark, folder).mapInPandas(zipped, "path string, content binary")
    return digested(archives.read_archives(made, ["doc_id", "text", "lang"]))


QUOTES = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE
      md5(replace(text, chr(13), '')) END AS text_md5, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      coalesce(CAST(n_chars AS VARCHAR), '') AS n_chars, coalesce(lang, '') || '5" pipe' AS mark FROM documents
    UNION ALL SELECT CAST(-1 - doc_id AS VARCHAR), '', '', '', '', '' FROM documents WHERE doc_id % 7 = 2"""
QUOTED_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "mark"]


def quoted_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in full as a CSV record with line breaks, quotes and a stray quote; beside these, records of one
    field and records that are too long, some with their long rest beginning empty."""
    docs = table(spark, folder, "documents")
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), F.lit('"'), F.lit('""'))
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "n_chars")]
    mark = F.concat(F.coalesce("lang", F.lit("")), F.lit('5" pipe'))
    field = F.concat(F.lit('"'), text, F.lit('"'))
    whole = F.concat_ws(",", F.col("doc_id").cast("string"), field, *rest, mark)
    short = (-1 - F.col("doc_id")).cast("string")
    kind = F.col("doc_id") % 7
    more = F.when(kind == 2, F.array(short)).when(kind == 4, F.array(F.concat(whole, F.lit(",extra"))))
    more = more.when(kind == 5, F.array(F.concat(whole, F.lit(",,z")))).otherwise(F.array().cast("array<string>"))
    return docs.select(F.explode(F.concat(F.array(whole), more)).alias("value"))


def all_digested(rows: DataFrame) -> DataFrame:
    cleaned = bulkcsv.clean_text(rows, na_tokens=())
    digest = F.when(F.col("text") == "", "").otherwise(F.md5("text"))
    return cleaned.select("doc_id", digest.alias("text_md5"), *QUOTED_COLUMNS[2:])


@query(QUOTES)
def bulk_one_file(spark, folder):
    """The records as one file, which is read by as many tasks as it has splits."""
    path = fresh_path(spark, "one_file")
    header = spark.createDataFrame([(",".join(QUOTED_COLUMNS),)], "value string")
    header.unionAll(quoted_records(spark, folder)).coalesce(1).write.text(path)
    return all_digested(bulkcsv.read_text_csv(spark, path))


@query(QUOTES)
def archive_quotes(spark, folder):
    """The records through archives, each unpacked into parts that other tasks read."""

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("documents.csv", "\n".join([",".join(QUOTED_COLUMNS), *batch["value"]]) + "\n")
            content = buffer.getvalue()
            yield pd.DataFrame({"path": [f"{hashlib.md5(content).hexdigest()}.zip"], "content": [content]})

    made = quoted_records(spark, folder).mapInPandas(zipped, "path string, content binary")
    return all_digested(archives.read_archives(stage(made, "zipped"), QUOTED_COLUMNS))


@query(
    """SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 2 = 0 THEN n_chars + 0.5 ELSE n_chars END AS size
    FROM documents"""
)
def json_mixed(spark, folder):
    """A folder of files with an object per line and of files that are one array each."""
    path = fresh_path(spark, "mixed")
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    even = F.col("doc_id") % 2 == 0
    docs.filter(~even).withColumn("size", F.col("n_chars")).write.json(f"{path}/lines")

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [value for batch in batches for value in batch["value"]]
        yield pd.DataFrame({"value": ["[" + ",\n".join(rows) + "]"]})

    halves = docs.filter(even).withColumn("size", F.col("n_chars") + 0.5)
    halves.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(arrays, "value string").write.text(f"{path}/arrays")
    return files.read_json(spark, [f"{path}/lines", f"{path}/arrays"]).select("doc_id", "lang", "source", "n_chars", "size")


def event_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a landed page. Large values are refused with status 400; large errors have no next link."""
    event = F.struct("event_id", "event_type", "value")
    ends = (F.col("event_type") == "error") & (F.col("value") > 330)
    links = F.struct(F.when(~ends, "next").alias("next"))
    body = F.to_json(F.struct(F.array(event).alias("data"), links.alias("links")))
    return table(spark, folder, "events").select(
        (F.col("event_id") + 1).alias("page_no"),
        F.when(F.col("value") > 420, 400).otherwise(200).alias("status"),
        body.alias("body"),
    )


@query(
    """WITH e AS (SELECT min(CASE WHEN value > 420 THEN event_id WHEN event_type = 'error' AND value > 330
      THEN event_id + 1 END) AS last_page FROM events)
    SELECT event_id + 1 AS page_no, event_type FROM events, e WHERE event_id < coalesce(e.last_page, event_id + 1)"""
)
def page_cut(spark, folder):
    kept = pages.cut_pages(event_pages(spark, folder))
    return kept.select("page_no", F.get_json_object("body", "$.data[0].event_type").alias("event_type"))


def pages_of(rows: DataFrame, per_page: int = 1) -> DataFrame:
    """Entities as nested records, ``per_page`` to a landed page; columns that are not there are left out."""

    def named(path: str, column: str):
        return F.struct(F.col(column).alias(path)).alias

    def there(*columns: str) -> list:
        return [F.col(c).alias(JSON_NAMES.get(c, c)) for c in columns if c in rows.columns]

    address = there("address_line1", "city", "region", "country", "postal_code")
    address = [F.array(c).alias("addressLines") if i == 0 and "address_line1" in rows.columns else c for i, c in enumerate(address)]
    entity = F.struct(
        named("name", "legal_name")("legalName"),
        named("id", "legal_form")("legalForm"),
        *there("jurisdiction", "category", "status", "creation_date"),
        F.struct(*address).alias("legalAddress"),
    )

    def parent(kind: str):
        return F.struct(named("id", f"{kind}_parent_lei")("data")).alias(f"{kind}-parent")

    record = F.struct(
        F.struct(F.col("lei"), entity.alias("entity"), *there("last_update")).alias("attributes"),
        F.struct(parent("direct"), parent("ultimate")).alias("relationships"),
    )
    keep = {"ignoreNullFields": "false"}
    if per_page == 1:
        return rows.select(F.to_json(F.struct(F.array(record).alias("data")), keep).alias("body"))
    page = F.pmod(F.xxhash64("lei"), F.lit(max(1, rows.count() // per_page)))
    grouped = rows.select(page.alias("page"), record.alias("record")).groupBy("page")
    return grouped.agg(F.to_json(F.struct(F.collect_list("record").alias("data")), keep).alias("body")).select("body")


JSON_NAMES = {"creation_date": "creationDate", "postal_code": "postalCode", "last_update": "lastUpdateDate"}


def entity_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages_of(entities(spark, folder))


FLAT = """SELECT lei, legal_name, legal_form, jurisdiction, '' AS category, status, '' AS creation_date,
  '' AS address_line1, '' AS city, '' AS region, country, '' AS postal_code, direct_parent_lei,
  ultimate_parent_lei, '' AS last_update FROM ent"""


@query(
    ENT
    + """SELECT lei, legal_name, legal_form, jurisdiction, 'c' || legal_form AS category, status,
    '2020-' || legal_name AS creation_date, 'Line ' || lei AS address_line1, 'City ' || legal_form AS city,
    jurisdiction AS region, country, 'P' || lei AS postal_code, direct_parent_lei, ultimate_parent_lei,
    'U' || lei AS last_update FROM ent"""
)
def flatten_records(spark, folder):
    """Many records to a page, with every field."""
    full = entities(spark, folder).withColumns(
        {
            "category": F.concat(F.lit("c"), "legal_form"),
            "creation_date": F.concat(F.lit("2020-"), "legal_name"),
            "address_line1": F.concat(F.lit("Line "), "lei"),
            "city": F.concat(F.lit("City "), "legal_form"),
            "region": F.col("jurisdiction"),
            "postal_code": F.concat(F.lit("P"), "lei"),
            "last_update": F.concat(F.lit("U"), "lei"),
        }
    )
    return records.entities_of(pages_of(full, per_page=50))


@query("SELECT event_id, props->>'$.k' AS k, '' AS missing FROM events")
def json_extract(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        records.json_text(F.col("props"), "$.k").alias("k"),
        records.json_text(F.col("props"), "$.no.such").alias("missing"),
    )


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY ALL")
def spec_load(spark, folder):
    name = fresh_path(spark, "spec").rsplit("/", 1)[1].replace("-", "_")
    source = f"{folder}/events.parquet"
    rows = files.read_file(spark, source)
    TB.create_empty_like(rows, name, path=fresh_path(spark, name))
    loads.run_load(spark, loads.LoadSpec("events", "file", name, {"file_path": source}))
    return (
        spark.table(name)
        .groupBy("event_type")
        .agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))
    )


# ---- models and row shaping --------------------------------------------------------------------------


@query(
    ENT
    + """SELECT lei, legal_name, legal_form, jurisdiction, status, country, direct_parent_lei,
    ultimate_parent_lei FROM ent WHERE status = 'ACTIVE'"""
)
def entity_active(spark, folder):
    return models.active_entities(entities(spark, folder))


@query(
    ENT
    + """, parents AS (SELECT lei AS plei, legal_name AS pname FROM ent)
    SELECT e.lei, e.legal_name, e.legal_form, e.jurisdiction, e.status, e.country, e.direct_parent_lei,
      e.ultimate_parent_lei, d.pname AS direct_parent_name, u.pname AS ultimate_parent_name,
      CASE WHEN e.direct_parent_lei = '' AND e.ultimate_parent_lei = '' THEN 'Standalone'
           WHEN e.ultimate_parent_lei = e.lei THEN 'Ultimate Parent'
           WHEN e.direct_parent_lei <> '' THEN 'Subsidiary' ELSE 'Unknown' END AS hierarchy_level,
      CASE e.country WHEN 'US' THEN 'North America' WHEN 'GB' THEN 'Europe' WHEN 'DE' THEN 'Europe'
           WHEN 'JP' THEN 'Asia Pacific' ELSE 'Other' END AS region_group
    FROM ent e LEFT JOIN parents d ON d.plei = e.direct_parent_lei
      LEFT JOIN parents u ON u.plei = e.ultimate_parent_lei WHERE e.status = 'ACTIVE'"""
)
def entity_summary(spark, folder):
    return models.entity_summary(entities(spark, folder))


@query(
    ENT
    + """SELECT e.lei, e.legal_name, d.legal_name AS direct_parent_name, u.legal_name AS ultimate_parent_name
    FROM ent e LEFT JOIN ent d ON d.lei = e.direct_parent_lei LEFT JOIN ent u ON u.lei = e.ultimate_parent_lei
    WHERE e.direct_parent_lei <> '' OR e.ultimate_parent_lei <> ''"""
)
def entity_hierarchies(spark, folder):
    return models.entity_hierarchies(entities(spark, folder))


@query(
    ENT
    + """, k AS (SELECT * REPLACE (CASE WHEN lei = (SELECT min(lei) FROM ent) THEN '' ELSE lei END AS lei) FROM ent)
    SELECT e.lei, e.legal_name, d.legal_name AS direct_parent_name, u.legal_name AS ultimate_parent_name
    FROM k e LEFT JOIN k d ON d.lei = e.direct_parent_lei LEFT JOIN k u ON u.lei = e.ultimate_parent_lei
    WHERE e.direct_parent_lei <> '' OR e.ultimate_parent_lei <> ''"""
)
def hierarchy_view(spark, folder):
    """The view of the catalog, over a table in which one entity has the empty key."""
    name = new_name(spark, "hierarchy")
    rows = entities(spark, folder)
    first = rows.agg(F.min("lei").alias("first"))
    rows = rows.join(F.broadcast(first)).withColumn("lei", F.when(F.col("lei") == F.col("first"), "").otherwise(F.col("lei")))
    TB.create_entity_table(spark, name, fresh_path(spark, name))
    there = rows.withColumn(LOAD_TIME_COLUMN, F.localtimestamp())
    full = [F.col(f.name) if f.name in there.columns else F.lit("").alias(f.name) for f in ENTITY_SCHEMA]
    TB.upsert(there.select(*full), name)
    loads.create_entity_views(spark, name)
    return spark.newSession().table(f"{name}_hierarchies")


@query(
    ENT
    + """SELECT country, count(*) AS entity_count, count(DISTINCT jurisdiction) AS jurisdictions FROM ent
    GROUP BY country"""
)
def country_counts(spark, folder):
    return models.by_size(models.country_counts(entities(spark, folder)))


@query(
    ENT
    + """SELECT country, count(*) AS entity_count FROM ent WHERE country IS NOT NULL AND country <> ''
    GROUP BY country"""
)
def country_counts_clean(spark, folder):
    return models.by_size(models.country_counts_clean(entities(spark, folder), "country"))


@query(
    ENT
    + """SELECT count(*) AS total, count(DISTINCT country) FILTER (WHERE country <> '') AS countries
    FROM ent"""
)
def dataset_stats(spark, folder):
    return models.dataset_stats(entities(spark, folder), "country")


@query("SELECT count(*) AS row_count FROM lineitem")
def table_count(spark, folder):
    return table(spark, folder, "lineitem").agg(F.count("*").alias("row_count"))


@query(
    ENT
    + """SELECT lei, coalesce(country, '') AS country, coalesce(direct_parent_lei, '') AS direct_parent_lei
    FROM ent"""
)
def null_to_empty(spark, folder):
    return C.null_to_empty(entities(spark, folder)).select("lei", "country", "direct_parent_lei")


@query(ENT + f"SELECT lei, CASE WHEN country NOT IN ({NA_LIST}) THEN country END AS country FROM ent")
def na_tokens(spark, folder):
    return C.tokens_to_null(entities(spark, folder)).select("lei", "country")


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def preview(spark, folder):
    orders = table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return catalog.preview(orders)


@query("SELECT c_name || ' | ' || c_mktsegment || ' | ' || c_nationkey AS combined, c_custkey FROM customer")
def combined_text(spark, folder):
    text = R.combined_text(["c_name", "c_mktsegment", "c_nationkey"])
    return table(spark, folder, "customer").select(text.alias("combined"), "c_custkey")


@query(
    ENT
    + """SELECT lei, '{"lei":"' || lei || '","country":' || coalesce('"' || country || '"', 'null') || '}' AS js
    FROM ent"""
)
def row_json(spark, folder):
    return entities(spark, folder).select("lei", R.row_json(["lei", "country"]).alias("js"))


@query("""SELECT event_id, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '"}' AS js FROM events""")
def row_json_time(spark, folder):
    return table(spark, folder, "events").select("event_id", R.row_json(["ts"]).alias("js"))


@query(
    "SELECT l_orderkey, l_linenumber, printf('%.1f%% match', l_discount * 100) AS label FROM lineitem"
)
def match_label(spark, folder):
    label = R.match_label(F.col("l_discount")).alias("label")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", label)


@query(ENT + "SELECT lei, true AS has_time FROM ent")
def load_time(spark, folder):
    stamped = R.with_load_time(entities(spark, folder), LOAD_TIME_COLUMN)
    return stamped.select("lei", F.col(LOAD_TIME_COLUMN).isNotNull().alias("has_time"))


# ---- append and upsert ---------------------------------------------------------------------------------


@query(
    """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"""
)
def append_rows(spark, folder):
    parties = table(spark, folder, "customer").drop("c_mktsegment").toDF(
        "id", "name", "nation", "balance"
    )
    return TB.append_rows(parties, table(spark, folder, "supplier"))


UPSERTED = """WITH target AS (SELECT o_orderkey AS k, o_orderstatus AS state, o_totalprice AS amount
    FROM orders), batch AS (SELECT l_orderkey + 5 AS k, l_returnflag AS state, l_extendedprice AS amount FROM lineitem)
    SELECT * FROM target WHERE k NOT IN (SELECT k FROM batch) UNION ALL SELECT * FROM batch"""


def order_states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The orders, and the lines, five keys on, that replace them or come in new."""
    target = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    batch = table(spark, folder, "lineitem").select(F.col("l_orderkey") + 5, "l_returnflag", "l_extendedprice")
    return target.toDF("k", "state", "amount"), batch.toDF("k", "state", "amount")


def new_keyed_table(spark: SparkSession, schema: T.StructType, key: str, history: bool = False) -> str:
    path = fresh_path(spark, "keyed")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    TB.create_keyed_table(spark, name, schema, key, path=path, history=history)
    return name


@query(UPSERTED)
def upsert_plan(spark, folder):
    return TB.upsert_rows(*order_states(spark, folder), "k")


@query(UPSERTED)
def upsert(spark, folder):
    target, batch = order_states(spark, folder)
    name = new_keyed_table(spark, target.schema, "k")
    TB.upsert(target, name, staged=True)
    TB.upsert(batch, name, staged=True)
    return TB.keyed_rows(spark, name)


@query(UPSERTED)
def upsert_narrow_key(spark, folder):
    """A batch whose key has a narrower type than the table's."""
    target, batch = order_states(spark, folder)
    name = new_keyed_table(spark, target.schema, "k")
    TB.upsert(target, name, staged=True)
    TB.upsert(batch.withColumn("k", F.col("k").cast("int")), name, staged=True)
    return TB.keyed_rows(spark, name)


@query(
    """WITH first AS (SELECT o_orderkey AS k, o_orderstatus AS state, o_totalprice AS amount FROM orders),
    second AS (SELECT l_orderkey + 5 AS k, l_returnflag AS state, l_extendedprice AS amount FROM lineitem),
    third AS (SELECT o_custkey AS k, o_orderpriority AS state, o_totalprice AS amount FROM orders),
    two AS (SELECT * FROM first WHERE k NOT IN (SELECT k FROM second) UNION ALL SELECT * FROM second)
    SELECT * FROM two WHERE k NOT IN (SELECT k FROM third) UNION ALL SELECT * FROM third"""
)
def upsert_twice(spark, folder):
    """Two batches with common keys, one after the other and the second of them repeated."""
    target, batch = order_states(spark, folder)
    third = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    name = new_keyed_table(spark, target.schema, "k")
    for rows in (target, batch, third.toDF("k", "state", "amount"), third.toDF("k", "state", "amount")):
        TB.upsert(rows, name, staged=True)
    return TB.keyed_rows(spark, name)


MERGED = """WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS state, o_totalprice AS amount FROM orders),
    s AS (SELECT l_orderkey + 5 AS k, count(*) AS lines, min(l_returnflag) AS flag, max(l_extendedprice) AS price
          FROM lineitem GROUP BY ALL),
    merged AS (SELECT t.k, CASE WHEN s.flag <> t.state THEN s.flag ELSE t.state END AS state,
               CASE WHEN s.flag <> t.state THEN s.price ELSE t.amount END AS amount
               FROM t LEFT JOIN s ON t.k = s.k WHERE s.k IS NULL OR s.lines <= 5
               UNION ALL SELECT k, flag, price FROM s WHERE lines > 1 AND k NOT IN (SELECT k FROM t))"""


def merged_table(spark: SparkSession, folder: str) -> str:
    """The orders, with the lines, five keys on, merged in: large orders go, others take the flag and price."""
    target, _ = order_states(spark, folder)
    lines = table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") + 5).alias("k"))
    source = lines.agg(
        F.count("*").alias("lines"), F.min("l_returnflag").alias("flag"), F.max("l_extendedprice").alias("price")
    )
    name = new_keyed_table(spark, target.schema, "k", history=True)
    TB.upsert(target, name, staged=True)
    CH.merge_rows(
        source,
        name,
        update={"state": "s.flag", "amount": "s.price"},
        update_when="s.flag <> t.state",
        delete_when="s.lines > 5",
        insert={"state": "s.flag", "amount": "s.price"},
        insert_when="s.lines > 1",
    )
    return name


@query(f"{MERGED} SELECT * FROM merged")
def merge_rows(spark, folder):
    return TB.keyed_rows(spark, merged_table(spark, folder))


@query(
    f"""{MERGED}, new AS (SELECT k, CASE WHEN amount < 20000 THEN 'S' ELSE state END AS state, amount FROM merged
    WHERE k % 7 <> 0)
    SELECT t.*, CASE WHEN new.k IS NULL THEN 'removed' ELSE 'before' END AS _change FROM t LEFT JOIN new ON t.k = new.k
    WHERE new.k IS NULL OR t.state <> new.state OR t.amount <> new.amount
    UNION ALL SELECT new.*, CASE WHEN t.k IS NULL THEN 'added' ELSE 'after' END FROM new LEFT JOIN t ON t.k = new.k
    WHERE t.k IS NULL OR t.state <> new.state OR t.amount <> new.amount"""
)
def changes_between(spark, folder):
    """A merge, a deletion and an update over all orders, told from the orders as they were."""
    name = merged_table(spark, folder)
    CH.delete_rows(spark, name, "k % 7 = 0")
    CH.update_rows(spark, name, {"state": "'S'"}, "amount < 20000")
    return CH.changes_between(spark, name, 1)


@query(
    """SELECT l_orderkey, l_shipdate, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY
    l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1"""
)
def latest_per_key(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_linenumber", "l_quantity"
    )
    return TB.latest_per_key(lines, "l_orderkey", "l_shipdate")


# ---- incremental loads -----------------------------------------------------------------------------------


@query(
    ENT
    + """SELECT lei, legal_name || ' v3' AS legal_name, legal_form, jurisdiction, '' AS category, status,
    '' AS creation_date, '' AS address_line1, '' AS city, '' AS region, country, '' AS postal_code, direct_parent_lei,
    ultimate_parent_lei, '2024-01-03' AS last_update FROM ent"""
)
def incremental_upsert(spark, folder):
    """Three versions of every entity land in an order that differs from that of their updates."""
    landed, checkpoint = fresh_path(spark, "landed"), fresh_path(spark, "checkpoint")
    name = new_keyed_table(spark, ENTITY_SCHEMA, "lei")
    for versions in ((1, 3), (2,)):
        for n in versions:
            rows = entities(spark, folder).withColumn("legal_name", F.concat("legal_name", F.lit(f" v{n}")))
            bodies = pages_of(rows.withColumn("last_update", F.lit(f"2024-01-0{n}")))
            bodies.write.mode("append").text(landed)
        bodies = incremental.landed_pages(spark, landed, whole_files=False, files_per_batch=1)
        rows = R.with_load_time(records.entities_of(bodies), LOAD_TIME_COLUMN)
        incremental.upsert_stream(rows, name, checkpoint, dedupe_by="last_update").awaitTermination()
    return TB.keyed_rows(spark, name).drop(LOAD_TIME_COLUMN)


@query("SELECT event_id, user_id, event_type, value FROM events")
def incremental_append(spark, folder):
    landed = fresh_path(spark, "landed")
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    events.write.parquet(landed)
    path = fresh_path(spark, "appended")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    incremental.create_append_table(spark, name, events.schema, path)
    checkpoint = fresh_path(spark, "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        rows = incremental.landed_files(spark, landed, events.schema, "parquet")
        incremental.append_stream(rows, name, checkpoint).awaitTermination()
    return spark.table(name).drop(incremental.BATCH)


# ---- similarity ------------------------------------------------------------------------------------------

QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
SIMILAR = f"""SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {QUERY_VECTOR}), 9) AS s
    FROM embeddings"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").withColumnRenamed("embedding", "vector")


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    return vectors(spark, folder).filter("vec_id = 0").first()["vector"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    f"SELECT vec_id, label, round(s, 6) AS similarity FROM ({SIMILAR}) ORDER BY s DESC, vec_id LIMIT 5"
)
def cosine_topk(spark, folder):
    return rounded(
        S.search(vectors(spark, folder), query_vector(spark, folder), "vec_id"), "similarity"
    )


@query(
    f"""SELECT label, vec_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER
    (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM ({SIMILAR})) WHERE r <= 5"""
)
def cosine_topk_by_group(spark, folder):
    query = query_vector(spark, folder)
    return rounded(S.search_by_group(vectors(spark, folder), query, "vec_id", "label"), "similarity")


def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of every label, from partial sums per element."""
    return (
        table(spark, folder, "embeddings")
        .select("label", F.posexplode("embedding"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("mean"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("cells"))
        .select("label", F.col("cells.mean").alias("vector"))
    )


@query(
    """WITH cells AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i
      FROM embeddings), means AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY ALL),
    centroids AS (SELECT label, list(m ORDER BY i) AS c FROM means GROUP BY label),
    scored AS (SELECT q.label, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.c), 9) AS s
      FROM centroids q, embeddings e)
    SELECT label, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label
      ORDER BY s DESC, vec_id) AS r FROM scored) WHERE r <= 5"""
)
def cosine_topk_batch(spark, folder):
    found = S.search_many(
        vectors(spark, folder), label_centroids(spark, folder), "vec_id", "label"
    )
    return rounded(found, "similarity")


@query(
    """WITH cells AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i
      FROM embeddings), means AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY ALL),
    centroids AS (SELECT label, list(m ORDER BY i) AS c FROM means GROUP BY label)
    SELECT vec_id, e.label, round(list_dot_product(embedding::DOUBLE[], c), 6) AS product,
      round(round(list_cosine_similarity(embedding::DOUBLE[], c), 9), 6) AS similarity
    FROM embeddings e JOIN centroids q ON q.label = e.label"""
)
def cosine_to_centroid(spark, folder):
    """Every vector against the mean of its label; a label may hold any share of the rows."""
    centroids = label_centroids(spark, folder).toDF("centroid_label", "centroid")
    rows = vectors(spark, folder)
    joined = salted_join(rows, centroids, "label", "centroid_label", "inner", spread_by=["vec_id"])
    a, b = F.col("vector"), F.col("centroid")
    found = joined.select("vec_id", "label", V.dot(a, b).alias("product"), V.cosine(a, b).alias("similarity"))
    return rounded(found, "product", "similarity")


@query(
    f"SELECT vec_id, label, round(s, 6) AS similarity FROM ({SIMILAR}) ORDER BY s DESC, vec_id LIMIT 5"
)
def cosine_topk_pruned(spark, folder):
    pivot = label_centroids(spark, folder).orderBy("label").first()["vector"]
    index = S.with_pivot(vectors(spark, folder), pivot)
    return rounded(S.search_pruned(index, query_vector(spark, folder), "vec_id", pivot), "similarity")


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm
    FROM embeddings"""
)
def vector_norms(spark, folder):
    norm = F.round(V.l2_norm(F.col("embedding")), 6).alias("norm")
    return table(spark, folder, "embeddings").select("vec_id", norm)


DIM = 1 << 18


def sparse_sql(source: str, key: str, name: str) -> str:
    """SQL of the hashed tf-idf weights of a text column, with the idf of ``documents``."""
    return f"""{name}_tf AS (SELECT {key} AS id, ('0x' || substr(md5(t), 1, 7))::BIGINT % {DIM} AS bucket,
      count(*) AS tf FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM {source})
      WHERE t <> '' GROUP BY ALL),
    {name}_raw AS (SELECT id, bucket, tf * (ln((1 + (SELECT count(*) FROM documents))
      / (1 + coalesce(df, 0))) + 1) AS w FROM {name}_tf LEFT JOIN doc_df USING (bucket)),
    {name} AS (SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}_raw)"""


DOC_DF = f"""doc_df AS (SELECT bucket, count(*) AS df FROM (SELECT DISTINCT doc_id,
      ('0x' || substr(md5(t), 1, 7))::BIGINT % {DIM} AS bucket FROM (SELECT doc_id,
      unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM documents) WHERE t <> '') GROUP BY bucket)"""
SPARSE = f"WITH {DOC_DF}, {sparse_sql('documents', 'doc_id', 'd')}"
SPARSE_BOTH = f"{SPARSE}, {sparse_sql('benchmark', 'item_id', 'q')}"


def fitted(documents: DataFrame) -> X.HashedTfIdf:
    return X.HashedTfIdf.fit(documents, ["text"], DIM)


@query(f"{SPARSE} SELECT id AS doc_id, bucket, round(w, 6) AS weight FROM d")
def hash_tfidf(spark, folder):
    documents = spread_table(spark, folder, "documents").select("doc_id", "text")
    index = X.build_index(documents, ["text"], fitted(documents))
    return rounded(X.postings(index, "doc_id"), "weight").withColumn(
        "bucket", F.col("bucket").cast("long")
    )


@query(
    f"""{SPARSE} SELECT doc_id, lang, source, coalesce(n, 0) AS n_buckets, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END
    ::DOUBLE AS norm FROM documents LEFT JOIN (SELECT id, count(*) AS n FROM d GROUP BY id) ON id = doc_id"""
)
def index_documents(spark, folder):
    documents = spread_table(spark, folder, "documents")
    index = X.build_index(documents, ["text"], fitted(documents))
    size = F.size("vector.buckets").cast("long").alias("n_buckets")
    return index.select("doc_id", "lang", "source", size, "norm")


@query(
    f"""{SPARSE_BOTH}, scored AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.w * d.w), 9) AS s
      FROM q JOIN d USING (bucket) GROUP BY ALL)
    SELECT item_id, doc_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY item_id
      ORDER BY s DESC, doc_id) AS r FROM scored) WHERE r <= 3"""
)
def text_search(spark, folder):
    documents = spread_table(spark, folder, "documents").select("doc_id", "text")
    model = fitted(documents)
    index = X.build_index(documents, ["text"], model)
    questions = X.build_index(table(spark, folder, "benchmark"), ["text"], model)
    return rounded(S.search_many(index, questions, "doc_id", "item_id", 3), "similarity")


def question(spark: SparkSession, folder: str) -> str:
    return table(spark, folder, "benchmark").agg(F.min_by("text", "item_id")).first()[0]


def text_indexes(spark: SparkSession, folder: str):
    documents = spread_table(spark, folder, "documents").select("doc_id", "text")
    model = fitted(documents)
    items = table(spark, folder, "benchmark")
    return model, {
        "documents": (X.build_index(documents, ["text"], model), "doc_id"),
        "benchmark": (X.build_index(items, ["text"], model), "item_id"),
    }


@query(
    f"""{SPARSE_BOTH}, one AS (SELECT bucket, w FROM q WHERE id = (SELECT min(item_id) FROM benchmark)),
    hits AS (SELECT 0 AS table_position, 'documents' AS table_name, d.id, round(sum(one.w * d.w), 9) AS s FROM one
        JOIN d USING (bucket) GROUP BY ALL
      UNION ALL SELECT 1, 'benchmark', q.id, round(sum(one.w * q.w), 9) FROM one JOIN q USING (bucket)
        GROUP BY ALL)
    SELECT table_position, table_name, CAST(id AS VARCHAR) AS key, round(s, 6) AS similarity FROM (SELECT *,
      row_number() OVER (PARTITION BY table_position ORDER BY s DESC, id) AS r FROM hits) WHERE r <= 5"""
)
def search_tables(spark, folder):
    model, indexes = text_indexes(spark, folder)
    query = X.embed_text(spark, question(spark, folder), model)
    return rounded(S.search_tables(indexes, query).drop("data"), "similarity")


@query(
    f"""WITH hits AS (SELECT vec_id, label, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM ({SIMILAR})),
    top AS (SELECT * FROM hits WHERE r <= 5)
    SELECT 'Based on the following data:' || chr(10) || chr(10) || string_agg('Record ' || r || ': {{' || chr(10) ||
      '  "vec_id": ' || vec_id || ',' || chr(10) || '  "label": ' || label || chr(10) || '}}' || chr(10) || chr(10),
      '' ORDER BY r) AS context FROM top"""
)
def ask_context(spark, folder):
    index = {"embeddings": (vectors(spark, folder), "vec_id")}
    hits = S.search_tables(index, query_vector(spark, folder), S.TOP_K_ONE_TABLE)
    return S.context(hits).select("context")


@query(
    """WITH cells AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i
      FROM embeddings), means AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY ALL),
    centroids AS (SELECT label, list(m ORDER BY i) AS c FROM means GROUP BY label),
    scored AS (SELECT q.label AS question, e.vec_id, e.label,
      round(list_cosine_similarity(e.embedding::DOUBLE[], q.c), 9) AS s FROM centroids q, embeddings e),
    hits AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY s DESC, vec_id) AS r FROM scored)
    SELECT question, 'Based on the following data:' || chr(10) || chr(10) || string_agg('Record ' || r || ': {' ||
      chr(10) || '  "vec_id": ' || vec_id || ',' || chr(10) || '  "label": ' || label || chr(10) || '}' || chr(10)
      || chr(10), '' ORDER BY r) AS context FROM hits WHERE r <= 5 GROUP BY question"""
)
def ask_many(spark, folder):
    questions = label_centroids(spark, folder).withColumnRenamed("label", "question")
    found = S.ask_many(vectors(spark, folder), questions, "vec_id", "question")
    return found.select("question", "context")


@query(
    f"""{SPARSE_BOTH} SELECT d.id AS doc_id, round(round(sum(one.w * d.w), 9), 6) AS similarity FROM (SELECT bucket, w FROM q
      WHERE id = (SELECT min(item_id) FROM benchmark)) AS one JOIN d USING (bucket) GROUP BY d.id
    ORDER BY round(sum(one.w * d.w), 9) DESC, d.id LIMIT 5"""
)
def text_search_postings(spark, folder):
    documents = spread_table(spark, folder, "documents").select("doc_id", "text")
    model = fitted(documents)
    path = fresh_path(spark, "postings")
    X.store_postings(X.build_index(documents, ["text"], model), "doc_id", path, groups=16)
    words = X.embed_text(spark, question(spark, folder), model)
    found = S.search_postings(spark.read.parquet(path), words, "doc_id")
    return rounded(found, "similarity")


def own_sparse_sql(source: str, key: str, name: str) -> str:
    """SQL of the hashed tf-idf weights of a table's text with its own idf, and of the question with the same idf."""
    words = "unnest(regexp_split_to_array(lower(text), '\\s+')) AS t"
    return f"""{name}_n AS (SELECT count(*) AS n FROM {source}),
    {name}_tf AS (SELECT id, ('0x' || substr(md5(t), 1, 7))::BIGINT % {DIM} AS bucket, count(*) AS tf
      FROM (SELECT {key} AS id, {words} FROM {source}) WHERE t <> '' GROUP BY ALL),
    {name}_idf AS (SELECT bucket, ln((1 + (SELECT n FROM {name}_n)) / (1 + count(*))) + 1 AS idf FROM {name}_tf GROUP BY bucket),
    {name}_q AS (SELECT ('0x' || substr(md5(t), 1, 7))::BIGINT % {DIM} AS bucket, count(*) AS tf
      FROM (SELECT {words} FROM (SELECT min_by(text, item_id) AS text FROM benchmark)) WHERE t <> '' GROUP BY ALL),
    {name}_qw AS (SELECT bucket, tf * coalesce(idf, ln(1 + (SELECT n FROM {name}_n)) + 1) AS w FROM {name}_q
      LEFT JOIN {name}_idf USING (bucket)),
    {name}_dw AS (SELECT id, bucket, tf * idf AS w FROM {name}_tf JOIN {name}_idf USING (bucket)),
    {name}_norm AS (SELECT id, sqrt(sum(w * w)) AS d FROM {name}_dw GROUP BY id),
    {name}_hits AS (SELECT '{source}' AS table_name, id, round(sum(d.w / d * q.w / (SELECT sqrt(sum(w * w)) FROM {name}_qw)), 9)
      AS s FROM {name}_dw d JOIN {name}_qw q USING (bucket) JOIN {name}_norm USING (id) GROUP BY id)"""


@query(
    f"""WITH {own_sparse_sql("documents", "doc_id", "a")}, {own_sparse_sql("benchmark", "item_id", "b")},
    hits AS (SELECT * FROM a_hits UNION ALL SELECT * FROM b_hits)
    SELECT table_name, CAST(id AS VARCHAR) AS key, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER
      (PARTITION BY table_name ORDER BY s DESC, id) AS r FROM hits) WHERE r <= 5"""
)
def ask_tables(spark, folder):
    """Two tables indexed and stored; another session finds the indexes and asks them."""
    names = {}
    for source, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        name = new_name(spark, source)
        names[name] = source
        table(spark, folder, source).select(key, "text").write.option("path", fresh_path(spark, name)).saveAsTable(name)
        X.store_index(spark, name, ["text"], key, dim=DIM, path=fresh_path(spark, f"{name}_index"))
    found = S.search_stored(spark.newSession(), question(spark, folder), list(names))
    plain = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rounded(found.select(plain[F.col("table_name")].alias("table_name"), "key", "similarity"), "similarity")


# ---- tables, views and models that last -----------------------------------------------------------------


def new_name(spark: SparkSession, label: str) -> str:
    return fresh_path(spark, label).rsplit("/", 1)[1].replace("-", "_")


@query(
    ENT
    + """SELECT country, count(*) AS entity_count, count(DISTINCT jurisdiction) AS jurisdictions FROM ent
    GROUP BY country"""
)
def load_chain(spark, folder):
    """Landed pages to the entity table and its views, read by another session."""
    name = new_name(spark, "entities")
    pages_ = entity_pages(spark, folder).select(
        F.monotonically_increasing_id().alias("page_no"),
        F.lit(200).alias("status"),
        F.replace("body", F.lit('{"data"'), F.lit('{"links":{"next":"x"},"data"')).alias("body"),
    )
    loads.load_entities(spark, pages_, name, path=fresh_path(spark, name))
    return spark.newSession().table(f"{name}_country_counts")


@query(
    """SELECT count(*) AS total, count(DISTINCT c) AS countries FROM (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'US'
    WHEN 1 THEN 'DE' ELSE NULL END AS c FROM customer)"""
)
def model_stats(spark, folder):
    """A bulk file with a country column, loaded, and its model run as a table."""
    path, name, target = fresh_path(spark, "bulk"), new_name(spark, "bulk"), new_name(spark, "stats")
    country = F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' ELSE 'NA' END")
    customer = table(spark, folder, "customer")
    customer.select("c_custkey", country.alias("Country")).write.option("header", True).csv(path)
    bulkcsv.load_bulk(spark, path, name, location=fresh_path(spark, name))
    models.run_model(spark, "dataset_stats", name, target)
    return spark.table(target)


@query("SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY p_brand")
def upload_file(spark, folder):
    name = new_name(spark, "uploaded")
    loads.upload(spark, f"{folder}/part.parquet", name)
    return catalog.sql_frame(
        spark, f"SELECT p_brand, count(*) AS n, sum(p_size) AS sizes FROM {name} GROUP BY p_brand"
    )


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def sql_ctas(spark, folder):
    name = new_name(spark, "made")
    TB.register(table(spark, folder, "customer"), "customer")
    query_ = "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"
    catalog.run_sql(spark, f"CREATE TABLE {name} USING parquet AS {query_}")
    return spark.table(name)


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def sql_file(spark, folder):
    text = f"SELECT p_partkey, p_size FROM parquet.`{folder}/part.parquet` WHERE p_size > 40"
    return catalog.sql_frame(spark, text)


@query("SELECT n_nationkey AS id, n_name AS name, r_regionkey AS id_1, r_name AS name_1 FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_duplicate_columns(spark, folder):
    for name in ("nation", "region"):
        TB.register(table(spark, folder, name), name)
    return catalog.sql_frame(
        spark,
        "SELECT n_nationkey AS id, n_name AS name, r_regionkey AS id, r_name AS name FROM nation JOIN region ON "
        "n_regionkey = r_regionkey",
    )


# ---- SQL: the session answers it; these check that it answers as expected --------------------------------


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register SQL text; ``oracle`` where the other engine spells it differently."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        used = {t: table(spark, folder, t) for t in TABLES if t in text}
        for view, df in used.items():
            TB.register(df, view)
        return catalog.sql_frame(spark, text)

    run.__name__ = name
    query(oracle or text)(run)


sql_query(
    "sql_passthrough",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus",
)
sql_query(
    "sql_filters",
    """SELECT p_partkey, p_name, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large'
    END AS size_class FROM part WHERE p_name LIKE '%ring%' AND p_size BETWEEN 5 AND 40
    AND p_type IN ('PROMO', 'LARGE', 'ECONOMY') AND NOT p_brand = 'Brand#1'""",
)
sql_query(
    "sql_joins",
    """SELECT 'inner' AS kind, n_name, count(*) AS n, count(s_suppkey) AS m FROM nation
      JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name
    UNION ALL SELECT 'left', n_name, count(*), count(s_suppkey) FROM nation
      LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name
    UNION ALL SELECT 'right', c_mktsegment, count(*), CAST(sum(p.n) AS BIGINT) FROM
      (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) AS p
      RIGHT JOIN customer ON p.o_custkey = c_custkey GROUP BY c_mktsegment
    UNION ALL SELECT 'full', coalesce(c_mktsegment, 'none'), count(*), CAST(sum(p.n) AS BIGINT) FROM
      (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey) AS p
      FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) AS c ON p.o_custkey = c_custkey
      GROUP BY coalesce(c_mktsegment, 'none')""",
)
sql_query(
    "sql_semi_anti",
    """SELECT c_custkey, c_name, 'has' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey
      FROM orders WHERE o_totalprice > 450000) AS big WHERE big.o_custkey = c_custkey)
    UNION ALL SELECT c_custkey, c_name, 'has not' FROM customer WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT
      o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent WHERE urgent.o_custkey = c_custkey)""",
)
sql_query(
    "sql_groupby",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
      round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first_ship, max(l_discount) AS top_discount
    FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
sql_query(
    "sql_grouping_sets",
    """SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g, count(*) AS n FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
)
sql_query(
    "sql_cube",
    "SELECT p_type, p_size, count(*) AS n, sum(p_partkey) AS keys FROM part GROUP BY CUBE (p_type, p_size)",
    """SELECT p_type, p_size, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM part
    GROUP BY CUBE (p_type, p_size)""",
)
sql_query(
    "sql_rollup",
    """SELECT r_name, n_name, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey
    JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)""",
)
sql_query(
    "sql_windows",
    """WITH monthly AS (SELECT l_returnflag AS flag, year(l_shipdate) * 100 + month(l_shipdate) AS ym,
        count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)
    SELECT flag, CAST(ym AS BIGINT) AS ym, qty,
      CAST(rank() OVER (PARTITION BY flag ORDER BY qty DESC) AS BIGINT) AS qty_rank,
      CAST(dense_rank() OVER (PARTITION BY ym ORDER BY n) AS BIGINT) AS n_rank,
      lag(qty) OVER (PARTITION BY flag ORDER BY ym) AS previous,
      lead(n, 2) OVER (PARTITION BY flag ORDER BY ym) AS two_later,
      CAST(ntile(4) OVER (PARTITION BY flag ORDER BY ym) AS BIGINT) AS quarter,
      first_value(qty) OVER (PARTITION BY flag ORDER BY ym) AS first_qty,
      sum(qty) OVER (PARTITION BY flag ORDER BY ym ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS moving,
      sum(qty) OVER (PARTITION BY flag ORDER BY ym) AS running FROM monthly""",
)
sql_query(
    "sql_qualify",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2""",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_totalprice DESC, o_orderkey) <= 2""",
)
sql_query("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
sql_query(
    "sql_distinct_on",
    """SELECT o_custkey, best.o_orderkey, best.o_totalprice FROM (SELECT o_custkey, max_by(struct(o_orderkey,
    o_totalprice), struct(o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey)""",
    """SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders
    ORDER BY o_custkey, o_totalprice DESC, o_orderkey""",
)
sql_query(
    "sql_setops",
    """(SELECT c_nationkey AS k, 'union' AS op FROM customer UNION SELECT s_nationkey, 'union' FROM supplier)
    UNION ALL (SELECT o_custkey, 'intersect' FROM orders INTERSECT SELECT l_partkey, 'intersect' FROM lineitem)
    UNION ALL (SELECT p_partkey, 'except' FROM part EXCEPT SELECT l_suppkey, 'except' FROM lineitem)""",
)
sql_query(
    "sql_subqueries",
    """SELECT c_custkey, c_acctbal, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top_order,
      t.n_orders FROM customer, LATERAL (SELECT count(*) AS n_orders FROM orders WHERE o_custkey = c_custkey) AS t
    WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)
      AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""",
)
sql_query(
    "sql_recursive",
    """WITH RECURSIVE years(y) AS (SELECT CAST(year(min(o_orderdate)) AS BIGINT) FROM orders
      UNION ALL SELECT y + 1 FROM years WHERE y < (SELECT year(max(o_orderdate)) FROM orders)),
    sold AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1)
    SELECT years.y AS order_year, coalesce(sold.n, 0) AS n FROM years LEFT JOIN sold ON sold.y = years.y""",
)
sql_query(
    "sql_pivot",
    """SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders)
    PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))""",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
    count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p
    FROM orders GROUP BY o_orderpriority""",
)
sql_query(
    "sql_strings",
    """SELECT c_custkey, upper(c_mktsegment) AS u, substr(c_name, 1, 8) AS head, CAST(length(c_name) AS BIGINT) AS len,
    replace(c_name, '#', '-') AS dashed, lpad(CAST(c_nationkey AS STRING), 3, '0') AS padded,
    trim(concat(' ', c_mktsegment, ' ')) AS trimmed, reverse(c_mktsegment) AS backwards FROM customer""",
)
sql_query(
    "sql_dates",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
    CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS first_day,
    CAST(CAST(o_orderdate + INTERVAL '7' DAY AS DATE) AS STRING) AS next_week,
    CAST(dayofyear(o_orderdate) AS BIGINT) AS doy FROM orders""",
)
sql_query(
    "sql_math",
    """SELECT p_partkey, abs(p_size - 25) AS off, round(sqrt(p_retailprice), 6) AS root, floor(p_retailprice) AS lo,
    ceil(p_retailprice) AS hi, p_size % 7 AS rest, round(ln(p_retailprice), 6) AS logged,
    round(power(p_size, 2), 2) AS squared, greatest(p_size, 20) AS at_least, sign(p_size - 25) AS side FROM part""",
    """SELECT p_partkey, abs(p_size - 25) AS off, round(sqrt(p_retailprice), 6) AS root,
    floor(p_retailprice)::BIGINT AS lo, ceil(p_retailprice)::BIGINT AS hi, p_size % 7 AS rest,
    round(ln(p_retailprice), 6) AS logged, round(power(p_size, 2), 2) AS squared,
    greatest(p_size, 20) AS at_least, sign(p_size - 25)::DOUBLE AS side FROM part""",
)
sql_query(
    "sql_json",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
    "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
)
sql_query(
    "sql_lists",
    """SELECT word, count(*) AS n, sum(len) AS total FROM (SELECT size(split(p_name, ' ')) AS len,
    explode(transform(split(p_name, ' '), w -> upper(w))) AS word FROM part) GROUP BY word""",
    """SELECT word, count(*) AS n, sum(len)::BIGINT AS total FROM (SELECT len(string_split(p_name, ' ')) AS len,
    unnest(list_transform(string_split(p_name, ' '), lambda w: upper(w))) AS word FROM part) GROUP BY word""",
)


@query(
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'),
      c AS (SELECT user_id, ts AS click_ts, event_id AS click_id FROM events WHERE event_type = 'click')
    SELECT p.event_id, p.user_id, c.click_ts, c.click_id FROM p ASOF LEFT JOIN c
      ON p.user_id = c.user_id AND p.ts >= c.click_ts"""
)
def sql_asof(spark, folder):
    events = table(spark, folder, "events")
    clicks = events.filter("event_type = 'click'").select(
        "user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id")
    )
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(purchases, clicks, ["user_id"], "ts", "click_ts", ["click_id"]).drop("ts")


@query(
    """WITH c AS (SELECT user_id, max(event_id) AS event_id, CAST(ts AS DATE) AS day FROM events GROUP BY user_id,
      CAST(ts AS DATE))
    SELECT e.event_id, e.user_id, c.day, c.event_id AS last_id FROM events e ASOF LEFT JOIN c
      ON e.user_id = c.user_id AND e.ts >= c.day"""
)
def asof_mixed_types(spark, folder):
    """Events with the last one of their user's latest day: times against dates, 64-bit keys against 32-bit ones."""
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    days = events.groupBy(F.col("user_id").cast("int").alias("user_id"), F.col("ts").cast("date").alias("day"))
    days = days.agg(F.max("event_id").alias("last_id"))
    return asof_join(events, days, ["user_id"], "ts", "day", ["last_id"]).drop("ts")


@query(
    """WITH w AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS y, min(o_orderdate) AS lo FROM orders
      GROUP BY ALL)
    SELECT priority, y, count(*) AS n, sum(l_quantity) AS quantity FROM w JOIN lineitem
      ON l_shipdate >= lo AND l_shipdate < lo + INTERVAL 30 DAY GROUP BY ALL"""
)
def sql_range_join(spark, folder):
    """Lines shipped in the thirty days from the first order of a priority in a year."""
    day = 86_400
    windows = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("long").alias("y"))
        .agg(F.unix_seconds(F.min("o_orderdate").cast("timestamp")).alias("lo"))
        .withColumn("hi", F.col("lo") + 30 * day)
    )
    # Lines of one moment are summed first, so that a frequent date is joined once.
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("shipped"))
        .agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))
    )
    found = range_join(lines, windows, "shipped", "lo", "hi", 30 * day)
    return found.groupBy("priority", "y").agg(
        F.sum("lines").alias("n"), F.sum("qty").alias("quantity")
    )

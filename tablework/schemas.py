"""Fixed values shared by the ingestion, model and search code."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names, order and record layout of the entity table ---------------
ENTITY_COLUMNS = [
    "lei",
    "legal_name",
    "legal_form",
    "jurisdiction",
    "category",
    "status",
    "creation_date",
    "address_line1",
    "city",
    "region",
    "country",
    "postal_code",
    "direct_parent_lei",
    "ultimate_parent_lei",
    "last_update",
]

# Where each entity column sits inside one element of a page's ``data`` array.
RECORD_PATHS = {
    "lei": "$.attributes.lei",
    "legal_name": "$.attributes.entity.legalName.name",
    "legal_form": "$.attributes.entity.legalForm.id",
    "jurisdiction": "$.attributes.entity.jurisdiction",
    "category": "$.attributes.entity.category",
    "status": "$.attributes.entity.status",
    "creation_date": "$.attributes.entity.creationDate",
    "address_line1": "$.attributes.entity.legalAddress.addressLines[0]",
    "city": "$.attributes.entity.legalAddress.city",
    "region": "$.attributes.entity.legalAddress.region",
    "country": "$.attributes.entity.legalAddress.country",
    "postal_code": "$.attributes.entity.legalAddress.postalCode",
    "direct_parent_lei": '$.relationships["direct-parent"].data.id',
    "ultimate_parent_lei": '$.relationships["ultimate-parent"].data.id',
    "last_update": "$.attributes.lastUpdateDate",
}

# Columns of the cleaned entity model, before enrichment.
SUMMARY_COLUMNS = [c for c in ENTITY_COLUMNS if c != "address_line1"]

REGION_GROUPS = {
    "North America": ["US", "USA", "United States"],
    "Europe": ["GB", "DE", "FR", "IT", "ES", "NL", "CH"],
    "Asia Pacific": ["JP", "CN", "HK", "SG", "KR"],
}
REGION_OTHER = "Other"

# Names under which the bulk file may carry the country, in order of preference.
COUNTRY_CANDIDATES = ["Entity.LegalAddress.Country", "LegalAddress.Country", "Country"]

# Texts that pandas reads as a missing value by default.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# --- end of fixed values --------------------------------------------------------------------

LOAD_TIME_COLUMN = "ingestion_timestamp"
# The column that tells versions of an entity apart.
UPDATE_COLUMN = "last_update"

ENTITY_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ENTITY_COLUMNS]
    + [T.StructField(LOAD_TIME_COLUMN, T.TimestampNTZType())]
)

PAGE_SCHEMA = "page_no long, status int, body string"

"""Table schemas, keys and foreign keys of the outreach data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def struct(columns: str) -> T.StructType:
    """``"id STRING, rating DOUBLE"`` as a schema; needs no running session, unlike Spark's own parser."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {
    "clinic_location": struct(
        "id STRING, name STRING, address STRING, city STRING, state STRING, zipCode STRING, phoneNumber STRING, "
        "faxNumber STRING, isActive BOOLEAN, createdAt TIMESTAMP_NTZ, updatedAt TIMESTAMP_NTZ"
    ),
    "referral_source": struct(
        "id STRING, name STRING, address STRING, city STRING, state STRING, zipCode STRING, clinicLocationId STRING, "
        "contactPerson STRING, contactTitle STRING, contactPhone STRING, contactEmail STRING, faxNumber STRING, "
        "npiNumber STRING, website STRING, notes STRING, rating DOUBLE, expectedMonthlyReferrals INT, "
        "numberOfProviders INT, createdAt TIMESTAMP_NTZ, updatedAt TIMESTAMP_NTZ, categoryId STRING"
    ),
    "referral_category": struct(
        "id STRING, name STRING, description STRING, createdAt TIMESTAMP_NTZ, updatedAt TIMESTAMP_NTZ"
    ),
    "interaction": struct(
        "id STRING, referralSourceId STRING, type STRING, date TIMESTAMP_NTZ, notes STRING, outcome STRING, "
        "createdAt TIMESTAMP_NTZ, updatedAt TIMESTAMP_NTZ"
    ),
    "campaign": struct(
        "id STRING, name STRING, description STRING, startDate TIMESTAMP_NTZ, endDate TIMESTAMP_NTZ, status STRING, "
        "type STRING, content STRING, documentUrl STRING, documentName STRING, coverSheetFromName STRING, "
        "coverSheetFromNumber STRING, coverSheetCompanyInfo STRING, coverSheetSubject STRING, "
        "coverSheetMessage STRING, includeCoverSheet BOOLEAN, createdAt TIMESTAMP_NTZ, updatedAt TIMESTAMP_NTZ"
    ),
    "campaign_link": struct(
        "campaignId STRING, referralSourceId STRING, status STRING, sentAt TIMESTAMP_NTZ, responseAt TIMESTAMP_NTZ, "
        "response STRING, createdAt TIMESTAMP_NTZ, updatedAt TIMESTAMP_NTZ"
    ),
}

LINK_KEY = ["campaignId", "referralSourceId"]

PRIMARY_KEYS: dict[str, list[str]] = {
    "clinic_location": ["id"],
    "referral_source": ["id"],
    "referral_category": ["id"],
    "interaction": ["id"],
    "campaign": ["id"],
    "campaign_link": LINK_KEY,
}

UNIQUE_NAMES = ["clinic_location", "referral_category"]

# (child table, foreign key, parent table, what deleting the parent does)
FOREIGN_KEYS = [
    ("referral_source", "categoryId", "referral_category", "SET NULL"),
    ("referral_source", "clinicLocationId", "clinic_location", "SET NULL"),
    ("interaction", "referralSourceId", "referral_source", "RESTRICT"),
    ("campaign_link", "campaignId", "campaign", "RESTRICT"),
    ("campaign_link", "referralSourceId", "referral_source", "RESTRICT"),
]

# values a row gets on insert when the request leaves them out
COLUMN_DEFAULTS: dict[str, dict[str, object]] = {
    "clinic_location": {"isActive": True},
    "campaign": {"status": "DRAFT", "includeCoverSheet": True},
    "campaign_link": {"status": "PENDING"},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns of ``table``, in order; columns it lacks become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ]
    )

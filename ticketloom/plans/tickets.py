"""Deterministic projection of the benchmark tables into tickets, decisions and model outputs.

The expressions are SQL text that means the same in Spark and in DuckDB, so the driver's check
starts from identical inputs. Only the operators themselves are written twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import balanced

# (complaint, true category, true priority, true department)
STEMS = [
    ("My invoice shows a wrong charge and the payment amount looks incorrect", "Billing", "Medium", "Finance"),
    ("Amount was deducted twice for one recharge", "Billing", "High", "Finance"),
    ("Please explain the balance on my prepaid plan", "Billing", "Low", "Finance"),
    ("Refund not received after I cancelled the order, still pending", "Refund", "High", "Refunds"),
    ("Please reverse the money, reimbursement would be fine", "Refund", "Low", "Refunds"),
    ("Waiting for a refund, there is some issue with the reversal", "Refund", "Medium", "Finance"),
    ("Mobile internet is slow and the signal drops frequently", "Technical", "Medium", "Technical"),
    ("Broadband router is dead since yesterday and nothing works", "Technical", "High", "Technical"),
    ("Tower collapsed near our colony and there is a complete outage", "Technical", "Critical", "Technical"),
    ("Unable to make any calls, calls dropping all day", "Technical", "High", "Technical"),
    ("Forgot the login password of my profile", "Account", "Low", "Account"),
    ("Someone did a SIM swap on my number without consent", "Account", "Critical", "Account"),
    ("Account locked and KYC shows a problem", "Account", "Medium", "Technical"),
    ("My service has been suspended even though I am a loyal customer", "Account", "High", "Account"),
    ("Unknown device logged into my account", "Account", "High", "Account"),
    ("There is a medical emergency at home and the line is not working", "Technical", "Critical", "Technical"),
    ("An unauthorized transaction was made, this is fraud", "Billing", "Critical", "Finance"),
    ("I will send a legal notice and go to the consumer court", "General", "Critical", "General Support"),
    ("This outage is affecting my business and we are losing clients", "Technical", "High", "Technical"),
    ("Double charge on the bill for the same month", "Billing", "High", "Refunds"),
    ("What are your opening hours on Sunday", "General", "Low", "General Support"),
    ("Hello", "General", "Low", "General Support"),
    ("Grandmother cannot reach her nurse when she falls", "General", "Critical", "General Support"),
    ("THE NETWORK IS DOWN in my street for the past 3 days", "Technical", "High", "Technical"),
]

SUFFIXES = [
    "",
    "I paid Rs. 499 at the counter.",
    "It began on 12/05/2024 in the evening.",
    "Call me on 9812345670 please.",
    "See ticket #AB-1042 for details.",
    "It has been so since last night.",
    "I tried a restart and checked the cables.",
    "My card is 4111 1111 1111 1111 if you need it.",
    "The OTP: 482913 came to my phone.",
    "again and again and again and again and again and again",
    "I would like to add that " + "the person at the desk told me to write once more and wait " * 12,
    "PLEASE Help Me ASAP, Thank You",
]

AS_OF = "2001-08-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(index: str, values: list[str]) -> str:
    branches = " ".join(f"WHEN {i} THEN {_quote(v)}" for i, v in enumerate(values))
    return f"CASE {index} {branches} END"


def _rotated(values: list[str], labels: list[str]) -> list[str]:
    return [labels[(labels.index(v) + 1) % len(labels)] for v in values]


_STEM_NO = "(o_orderkey % 24)"
_SUFFIX_NO = "(CAST(floor(o_orderkey / 24) AS BIGINT) % 12)"
_CATEGORY_LABELS = ["Billing", "Technical", "Account", "Refund", "General"]
_TRUE = [[stem[i] for stem in STEMS] for i in (1, 2, 3)]

RAW_COLUMNS = {
    "id": "o_orderkey",
    "ticket_id": "'TCK-' || CAST(o_orderkey AS STRING)",
    "contact_number": "'+9198' || lpad(CAST(o_custkey * 7919 % 100000000 AS STRING), 8, '0')",
    "review": (
        f"CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN 'nan' "
        f"ELSE rtrim({_case(_STEM_NO, [s[0] for s in STEMS])} || ' ' || {_case(_SUFFIX_NO, SUFFIXES)}) END"
    ),
    "timestamp": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "created_at": "o_orderdate",
    "category": (
        f"CASE WHEN o_orderkey % 13 = 0 THEN {_case(_STEM_NO, _rotated(_TRUE[0], _CATEGORY_LABELS))} "
        f"ELSE {_case(_STEM_NO, _TRUE[0])} END"
    ),
    "priority": _case(_STEM_NO, _TRUE[1]),
    "department": _case(_STEM_NO, _TRUE[2]),
    "difficulty": _case("(o_orderkey % 4)", ["easy", "medium", "hard", "ambiguous"]),
}

METADATA_COLUMNS = {
    "generation_batch": "'batch-' || o_orderstatus",
    "generation_source": "'orders'",
    "scenario_type": "o_orderpriority",
    "teacher_model": "'none'",
    "generation_timestamp": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "dataset_version": "'v1.0'",
    "key_index": "CAST(o_custkey % 3 AS INT)",
}

# Uploaded rows with gaps in the optional columns, by order status.
GAPPY_COLUMNS = {
    "customer_name": "CASE o_orderstatus WHEN 'F' THEN NULL ELSE c_name END",
    "contact_number": (
        "CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN '' "
        "ELSE '  ' || o_orderstatus || '-' || CAST(o_custkey AS STRING) || '  ' END"),
    "timestamp": "CASE o_orderstatus WHEN 'O' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
}

PHONE = (
    "CASE c_nationkey % 5 WHEN 0 THEN '+91-' || lpad(CAST(c_custkey * 7919 AS STRING), 10, '9') "
    "WHEN 1 THEN lpad(CAST(c_custkey AS STRING), 8, '0') WHEN 2 THEN CAST(c_custkey % 1000 AS STRING) "
    "WHEN 3 THEN NULL ELSE 'ext ' || CAST(c_custkey AS STRING) || ' / ' || CAST(c_nationkey AS STRING) END"
)

# Category and department that need not fit together, one pair per line item.
PAIR_COLUMNS = {
    "category": _case("(l_partkey % 5)", _CATEGORY_LABELS),
    "department": _case(
        "(l_suppkey % 5)", ["Finance", "Technical", "Account", "Refunds", "General Support"]),
}

# JSON lines with every kind of defect the validation knows.
_TEXT_FIELDS = ["ticket_id", "customer_name", "contact_number", "timestamp", "category", "priority"]
RECORD_LINE = (
    "'{\"fields\": {' || "
    + " || ', ' || ".join(
        f"'\"{f}\": \"' || " + (
            "CASE WHEN id % 23 = 0 THEN 'Urgent' ELSE priority END" if f == "priority" else f"coalesce({f}, '')")
        + " || '\"'" for f in _TEXT_FIELDS)
    + " || CASE WHEN id % 19 = 0 THEN '' ELSE ', \"department\": \"' || department || '\"' END"
    + " || ', \"review\": ' || CASE WHEN id % 29 = 0 THEN '5' WHEN id % 31 = 0 THEN '\" None \"' "
    + "ELSE '\"' || review || '\"' END"
    + " || '}, \"metadata\": {\"difficulty\": \"' || difficulty || '\"}' "
    + "|| CASE WHEN id % 17 = 0 THEN '' ELSE '}' END"
)

DECISION_COLUMNS = {
    "id": "l_orderkey",
    "kind": "CASE l_linestatus WHEN 'O' THEN 'resolve' ELSE 'override' END",
    "decided_category": _case("(l_partkey % 5)", _CATEGORY_LABELS),
    "decided_priority": _case("(l_suppkey % 4)", ["Critical", "High", "Medium", "Low"]),
    "decided_department": _case(
        "(l_partkey % 5)", ["Finance", "Technical", "Account", "Refunds", "General Support"]),
    "notes": "CASE WHEN l_linenumber = 1 THEN NULL ELSE 'checked line ' || CAST(l_linenumber AS STRING) END",
    "decided_at": "l_shipdate",
}
# A returned line stands for a reviewer's decision on its order's ticket.
DECISION_FILTER = "l_returnflag = 'R'"

MODEL_OUTPUT = (
    "CASE WHEN id % 17 = 0 THEN '{\"category\": \"' || category || '\", \"priority\": ' "
    "ELSE CASE WHEN id % 7 = 0 THEN 'The labels are: ' ELSE '' END "
    "|| CASE WHEN id % 5 = 0 THEN '```json ' ELSE '' END "
    "|| '{\"category\": \"' || category || '\", \"priority\": \"' || CASE WHEN id % 11 = 0 THEN 'Medium' ELSE priority END || '\"' "
    "|| CASE WHEN id % 19 = 0 THEN '' ELSE ', \"department\": \"' || department || '\"' END || '}' "
    "|| CASE WHEN id % 5 = 0 THEN ' ```' ELSE '' END END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded tickets without a customer name: one scan of ``orders``, no join."""
    return project(balanced(table(spark, sf_dir, "orders"), keep=True), RAW_COLUMNS)


def named_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded tickets with the customer name (null when the customer is unknown)."""
    orders, customer = balanced(table(spark, sf_dir, "orders"), keep=True), table(spark, sf_dir, "customer")
    joined = orders.join(customer.select("c_custkey", "c_name"),
                         orders.o_custkey == customer.c_custkey, "left")
    return project(joined, {**RAW_COLUMNS, "customer_name": "c_name"})


def gappy_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded tickets whose name, contact or time may be missing."""
    orders, customer = balanced(table(spark, sf_dir, "orders"), keep=True), table(spark, sf_dir, "customer")
    joined = orders.join(customer.select("c_custkey", "c_name"),
                         orders.o_custkey == customer.c_custkey, "left")
    return project(joined, {**RAW_COLUMNS, **GAPPY_COLUMNS})


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat labelled records: the eight fields, the metadata, and the numeric id."""
    orders, customer = balanced(table(spark, sf_dir, "orders"), keep=True), table(spark, sf_dir, "customer")
    joined = orders.join(customer.select("c_custkey", "c_name"),
                         orders.o_custkey == customer.c_custkey, "left")
    return project(joined, {**RAW_COLUMNS, "customer_name": "c_name", **METADATA_COLUMNS})


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as numbered JSON lines, some of them defective."""
    return named_tickets(spark, sf_dir).select(
        F.expr("id + 1").alias("line_no"), F.expr(RECORD_LINE).alias("line"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "lineitem").filter(DECISION_FILTER), DECISION_COLUMNS)


def model_outputs(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("raw_output", F.expr(MODEL_OUTPUT))


def as_of(moment: str = AS_OF) -> Column:
    return F.lit(moment).cast("timestamp_ntz")

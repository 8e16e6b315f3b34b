"""Linkable records derived from the tables ``documents`` of the driver.

The first words of a document are a name, the next an address.  Documents of the
same language and first words are the same organisation: the first is the record
of source 1, the others are records of sources 2 and 3.  Names and addresses are
then written in several ways, by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same text serves both engines; only these differ.
SPARK = {"tokens": "regexp_extract_all(lower(text), '[a-z0-9]+', 0)", "size": "size(k)", "four": "array_join(slice(k, 1, 4), ' ')", "next": "array_join(slice(k, 5, 4), ' ')", "first": "k[0]", "fifth": "k[4]", "str": "string"}
DUCKDB = {"tokens": "regexp_extract_all(lower(text), '[a-z0-9]+')", "size": "len(k)", "four": "array_to_string(list_slice(k, 1, 4), ' ')", "next": "array_to_string(list_slice(k, 5, 8), ' ')", "first": "k[1]", "fifth": "k[5]", "str": "varchar"}

TEMPLATE = """
select case when rn = 1 then 'S1-' when doc_id % 2 = 0 then 'S2-' else 'S3-' end || cast(doc_id as {str}) as entity_id,
  case doc_id % 8 when 0 then nm when 1 then nm || ' dba ' || w5 when 2 then 'The ' || nm || ' & Co' when 3 then nm || ' | www.' || w1 || '.com'
    when 4 then nm || ' l l c' when 5 then replace(nm, 'e', '3') when 6 then '<NULL> ' || nm || ' Ltd' else upper(nm) || '''s Bros' end as business_name,
  cast(n_chars as {str}) || ' ' || ad || case doc_id % 6 when 0 then ' st, Florida' when 1 then ' rd apt12' when 2 then ', 5th ave, near 1056c ' || w1 when 3 then ', N/A'
    when 4 then ' avenue, 33' || cast(n_chars % 900 + 100 as {str}) else '' end || ', ' || source as business_address,
  case when lang = 'en' then 'US' else lang end as country, nm, lang
from (select *, row_number() over (partition by lang, nm order by doc_id) as rn
      from (select doc_id, lang, source, n_chars, {four} as nm, {next} as ad, {first} as w1, {fifth} as w5 from (select *, {tokens} as k from documents) t where {size} >= 8) u) r
"""


def records_sql(dialect: dict[str, str]) -> str:
    return TEMPLATE.format(**dialect)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address, country, and nm and lang, which say who is the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return spark.sql(records_sql(SPARK).replace("from documents", "from {docs}"), docs=docs)


def truth(records: DataFrame) -> DataFrame:
    """source1_entity_id and its comma list of matches, possibly empty, for each record of source 1."""
    first = records.where("entity_id like 'S1-%'").select(F.col("entity_id").alias("source1_entity_id"), "nm", "lang")
    other = records.where("entity_id not like 'S1-%'").groupBy("nm", "lang").agg(F.expr("listagg(entity_id, ',') within group (order by entity_id)").alias("matched_entity_ids"))
    return first.join(other, ["nm", "lang"], "left").select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))

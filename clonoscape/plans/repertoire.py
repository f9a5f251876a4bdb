"""A deterministic repertoire derived from the ``customer`` table.

The test tables hold no receptor sequences; this view gives sequences of 12 to
17 residues.  Most of eight customers in a row share a core and differ from one
another in one or two places, some have one residue more, some a core of
their own, and some are the same, so that sequences and near pairs grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clonoscape.operators.graph import parts

#: Runs unchanged on Spark and DuckDB.
VIEW = """
select id, v_gene, patient, counts,
       concat('CASS', substring(core, 1, pos - 1), mut, substring(core, pos + 1, 8), more, 'EQYF') as cdr3
from (select c_custkey as id,
             concat('TRBV', cast(case when k % 5 = 0 then c_nationkey % 7 else grp % 7 end as varchar(9))) as v_gene,
             c_mktsegment as patient, 1 + c_custkey % 4 as counts,
             substring(translate(md5(cast(case when k % 11 = 0 then -k else grp end as varchar(12))), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 1, cast(4 + grp % 5 as int)) as core,
             cast(1 + k % (4 + grp % 5) as int) as pos,
             substring('ACDEFGHIKLMNPQRSTVWY', cast(1 + (k * 7) % 20 as int), 1) as mut,
             case when k % 9 = 0 then 'G' else '' end as more
      from (select *, cast(floor(k / 8) as bigint) as grp from (select *, c_custkey - case when c_custkey % 10 = 3 then 1 else 0 end as k from {customer}) a) c) t
"""


def repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view; joins with it are merged, as a few MB of keys become far more text than a driver can broadcast.

    Rows are dealt out first, for so small a file is read by few tasks.
    """
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").repartition(parts(spark), "c_custkey")
    return spark.sql(VIEW.replace("{customer}", "{c}"), c=customer).hint("merge")


#: The same as a common table expression for SQL.
CTE = "rep as (" + VIEW.replace("{customer}", "customer") + ")"

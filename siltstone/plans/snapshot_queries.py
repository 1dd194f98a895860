"""Queries on snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots
from ..tables import read


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints added, removed or modified since the project's previous delivered snapshot."""
    return snapshots.endpoint_changes(read(spark, sf_dir, "endpoints"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by project, snapshot and kind."""
    return p3_found(spark, sf_dir).groupBy("project", "snapshot_no", "change").agg(F.count("*").alias("changes"))


FOUND_SQL = """
with keyed as (
  select project, snapshot_no, received_at, row_id,
    case when protocol = 'rest' then 'rest:' || upper(trim(httpMethod)) || ':' || regexp_replace(trim(path), '/+$', '')
         when protocol = 'graphql' then 'graphql:' || operationType || ':' || fieldName
         else protocol || ':' || name end as k,
    handler, returnType,
    list_sort(list_distinct(list_transform(coalesce(parameters, []), lambda p: coalesce(p.name, '~') || '|' || coalesce(p.type, '~') || '|' || coalesce(p.required::varchar, '~')))) as ps
  from endpoints where project is not null and snapshot_no is not null),
held as (select * from keyed where k is not null qualify row_number() over (partition by project, snapshot_no, k order by received_at desc, row_id desc) = 1),
delivered as (select project, snapshot_no, lag(snapshot_no) over (partition by project order by snapshot_no) as prev from (select distinct project, snapshot_no from keyed)),
cur as (select h.*, d.prev from held h join delivered d using (project, snapshot_no) where d.prev is not null),
old as (select h.*, d.snapshot_no as later from held h join delivered d on h.project = d.project and h.snapshot_no = d.prev),
changes as (
  select coalesce(c.project, o.project) as project, coalesce(c.snapshot_no, o.later) as snapshot_no, coalesce(c.k, o.k) as endpoint_key,
    case when o.k is null then 'added' when c.k is null then 'removed'
         when c.handler is distinct from o.handler or c.returnType is distinct from o.returnType or c.ps is distinct from o.ps then 'modified' end as change
  from cur c full join old o on c.project = o.project and c.snapshot_no = o.later and c.k = o.k)
"""
QUERIES = {f.__name__: f for f in (p3_found, p3_counts)}
ORACLE = {
    "p3_found": FOUND_SQL + "select project, snapshot_no, endpoint_key, change from changes where change is not null",
    "p3_counts": FOUND_SQL + "select project, snapshot_no, change, count(*) as changes from changes where change is not null group by all",
}

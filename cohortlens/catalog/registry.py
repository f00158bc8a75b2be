"""Query registry and the SQL text of the input views, shared by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

Query = Callable[[SparkSession, str], DataFrame]
#: Bootstrap draws of the queries that SQL checks slot by slot, and the protocol's own number, a fixed value.
REPLICATES, PROTOCOL_REPLICATES = 1000, 10_000
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where one can express it."""
    def keep(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(tune(spark), folder)
        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build
    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def parts(df: DataFrame, vector: str, dim: int, digits: int = 6, prefix: str = "v") -> DataFrame:
    """Vector elements as rounded columns."""
    others = [c for c in df.columns if c != vector]
    return df.select(*others, *[F.round(F.get(vector, F.lit(i)), digits).alias(f"{prefix}{i}") for i in range(dim)])


def with_views(body: str, *names: str) -> str:
    """``with <views>`` in declaration order, followed by ``body``."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in DEPENDS.get(name, ()):
            need(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        need(name)
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed) + "\n" + body


COARSE_CASE = "case {0} when '1-URGENT' then 'Normal' when '5-LOW' then 'Reject' else 'Abnormal' end"

HEAD = 512


def fold_views(name: str, source: str) -> dict[str, str]:
    """Five folds of the groups of ``source`` (task, group_id, y) by greedy placing: views ``<name>`` (task, group_id, fold_id) and what it needs."""
    n = name

    def walk(start: str, at: str, step: str, bucket: str, more: str) -> str:
        score = ("list_reduce(list_transform(x, lambda q, c: q*v[c]*ws[c]), lambda a, b: a+b)")
        choice = f"list_sort(list_transform(loads, lambda x, j: {{'s': {score}, 'z': list_sum(x), 'r': (j-1-{bucket}%5+5)%5, 'j': j-1}}))[1].j"
        return f"""{start} union all select task, bucket, buckets, pos, list_transform(loads, lambda x, j: case when j-1=fold_id
 then list_transform(x, lambda q, c: q+{step}*v[c]) else x end), fold_id, group_id
 from (select *, ({choice})::int fold_id from (select h.task, h.bucket, h.buckets, h.pos+1 pos, h.loads, s.group_id, s.v, s.ws
 from {more} h join {n}_seq s on s.task=h.task and s.place={at}))"""

    return {
        f"{n}_cls": f"""select task, list(y order by y) ys, list(1.0::double/(t::double*t::double) order by y) ws
 from (select task, y, count(*) t from ({source}) group by all) group by task""",
        f"{n}_vec": f"""select task, group_id, list(coalesce(n,0)::double order by y) v from (select distinct task, group_id from ({source}))
 join (select task, unnest(ys) y from {n}_cls) using (task) left join (select task, group_id, y, count(*) n from ({source}) group by all) using (task, group_id, y)
 group by all""",
        f"{n}_seq": f"""select task, group_id, v, ws, row_number() over (partition by task order by
 list_sum(list_transform(v, lambda x: x*x))*len(v)-list_sum(v)*list_sum(v) desc, md5(group_id::varchar), group_id)-1 place from {n}_vec join {n}_cls using (task)""",
        f"{n}_head": walk(f"""select task, 0::bigint bucket, 1::bigint buckets, -1::bigint pos, list_transform(range(5), lambda j: list_transform(ws, lambda w: 0.0::double)) loads,
 -1::int fold_id, null::bigint group_id from {n}_cls""", f"h.pos+1 and s.place<{HEAD}", "1", "0", f"{n}_head"),
        f"{n}_rest": walk(f"""select task, b bucket, buckets, -1::bigint pos, loads, -1::int fold_id, null::bigint group_id from (select task, loads, buckets, unnest(range(buckets)) b
 from (select task, arg_max(loads, pos) loads from {n}_head group by task) join
 (select task, greatest(1, ceil((count(*)-{HEAD})/{HEAD}.0))::bigint buckets from {n}_seq group by task) using (task))""",
                          f"{HEAD}+h.bucket+h.buckets*(h.pos+1)", "buckets", "bucket", f"{n}_rest"),
        n: f"select task, group_id, fold_id from (select * from {n}_head union all select * from {n}_rest) where fold_id>=0",
    }


FOLD_SOURCES = {"efold": "select task, group_id, y from etask where split='train'", "cfold": "select task, group_id, y from ctask where split='train2022'",
                "gfold": "select 'all' task, group_id, coarse_label y from recs where split='train2022'"}

SE_SP = """sum(case when y_true in ('Abnormal','2-HIGH','3-MEDIUM','4-NOT SPECIFIED') and y_true=y_pred then 1 else 0 end)::double
  /nullif(sum(case when y_true in ('Abnormal','2-HIGH','3-MEDIUM','4-NOT SPECIFIED') then 1 else 0 end),0) SE,
 sum(case when y_true in ('Normal','1-URGENT') and y_true=y_pred then 1 else 0 end)::double
  /nullif(sum(case when y_true in ('Normal','1-URGENT') then 1 else 0 end),0) SP"""

VIEWS = {
    "recs": """select o_orderkey record_id, o_custkey group_id, cast(year(o_orderdate) as int) yr,
 case when year(o_orderdate)=1995 then 'train2022' when year(o_orderdate)<=1997 then 'test2022' else 'test2023' end split,
 c_mktsegment device, o_orderpriority fine_label,
 case o_orderpriority when '1-URGENT' then 'Normal' when '5-LOW' then 'Reject' else 'Abnormal' end coarse_label,
 case when o_orderpriority='5-LOW' then 'excluded' else 'included' end inclusion_status,
 case when o_orderpriority='5-LOW' then 'poor_quality_only' end exclusion_reason
 from orders join customer on o_custkey=c_custkey""",
    "fine": "select * from (values (0,'1-URGENT'),(1,'2-HIGH'),(2,'3-MEDIUM'),(3,'4-NOT SPECIFIED'),(4,'5-LOW')) t(j,cls)",
    "meth": "select * from (values (0,'CLS'),(1,'TG')) t(mi,method)",
    "raws": """select record_id, group_id, split, fine_label y_true, method, j, cls,
 (record_id*7919+j*104729+mi*15485863+13)%1000+1+case when cls=fine_label then 600 else 0 end raw
 from recs cross join fine cross join meth""",
    "scores_long": """select record_id, group_id, split, y_true, method, j, cls,
 cast(raw as double)/cast(sum(raw) over (partition by record_id,method) as double) p from raws""",
    "scores3": """select * from scores_long union all
 select a.record_id, a.group_id, a.split, a.y_true, 'Fusion', a.j, a.cls, 0.5::double*a.p+0.5::double*b.p
 from scores_long a join scores_long b on a.record_id=b.record_id and a.j=b.j and a.method='CLS' and b.method='TG'""",
    "pred3": """select record_id, group_id, split, y_true, method, cls y_pred from
 (select *, row_number() over (partition by record_id,method order by p desc,j) rk from scores3) q where rk=1""",
    "tp": f"""select case when split='test2023' then 'Set2023' else 'Set2022' end dataset, split evaluation, task, method,
 case method when 'CLS' then 'phase1' when 'TG' then 'phase2' else 'phase3' end phase, record_id, group_id,
 case when task='T2-1' then {COARSE_CASE.format('y_true')} else y_true end y_true,
 case when task='T2-1' then {COARSE_CASE.format('y_pred')} else y_pred end y_pred
 from pred3 cross join (values ('T2-1'),('T2-2')) t(task)""",
    "cl": """select * from (values ('T2-1',1,'Normal'),('T2-1',2,'Abnormal'),('T2-1',3,'Reject'),
 ('T2-2',1,'1-URGENT'),('T2-2',2,'2-HIGH'),('T2-2',3,'3-MEDIUM'),('T2-2',4,'4-NOT SPECIFIED'),('T2-2',5,'5-LOW')) t(task,pos,cls)""",
    "conf": """select dataset, evaluation, task, method, phase, y_true t, y_pred p, count(*) n from tp group by all""",
    "pc": """select g.dataset, g.evaluation, g.task, g.method, g.phase, cl.cls, cl.pos,
 coalesce(sum(case when t=cls and p=cls then n end),0) tp, coalesce(sum(case when t=cls then n end),0) sup,
 coalesce(sum(case when p=cls then n end),0) prd
 from (select distinct dataset, evaluation, task, method, phase from conf) g join cl on g.task=cl.task
 left join conf c on c.evaluation=g.evaluation and c.task=g.task and c.method=g.method and (c.t=cls or c.p=cls) group by all""",
    "pr": """select *, case when sup=0 then 0.0::double else tp::double/sup end rec,
 case when prd=0 then 0.0::double else tp::double/prd end prec from pc""",
    "met": """select dataset, evaluation, task, method, phase, avg(rec) balanced_accuracy,
 avg(case when prec+rec=0 then 0.0::double else 2*prec*rec/(prec+rec) end) macro_f1,
 sum(tp)::double/sum(sup)::double accuracy, sum(sup)::bigint record_count,
 avg(case when sup>0 then rec end) ba_observed from pr group by all""",
    "sens": """select * from (values ('T2-1','Abnormal'),('T2-2','2-HIGH'),('T2-2','3-MEDIUM'),('T2-2','4-NOT SPECIFIED')) t(task,cls)""",
    "off0": """select evaluation, task, method, count(*) record_count,
 sum(case when y_true in ('Abnormal','2-HIGH','3-MEDIUM','4-NOT SPECIFIED') and y_true=y_pred then 1 else 0 end)::double
  /nullif(sum(case when y_true in ('Abnormal','2-HIGH','3-MEDIUM','4-NOT SPECIFIED') then 1 else 0 end),0) SE,
 sum(case when y_true in ('Normal','1-URGENT') and y_true=y_pred then 1 else 0 end)::double
  /nullif(sum(case when y_true in ('Normal','1-URGENT') then 1 else 0 end),0) SP from tp group by all""",
    "off": """select *, (SE+SP)/2 "AS", case when SE+SP=0 then 0.0::double else 2*SE*SP/(SE+SP) end HS,
 ((SE+SP)/2+case when SE+SP=0 then 0.0::double else 2*SE*SP/(SE+SP) end)/2 Score from off0""",
    "board": """select case when c_custkey%2=0 then 'test2022' else 'test2023' end evaluation,
 case when c_nationkey%2=0 then 'T2-1' else 'T2-2' end task,
 case when c_custkey%3=0 then 'Table III' else 'Table II' end tbl, c_name team, (c_acctbal+1000.0::double)/11000.0::double score from customer""",
    "wins": """select l_orderkey record_id, row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_shipdate,l_quantity)-1 window_index,
 l_quantity f0, l_extendedprice f1, l_discount f2, l_tax f3 from lineitem""",
    "winl": """select record_id, window_index, unnest([0,1,2,3]) dim, unnest([f0,f1,f2,f3]) x from wins""",
    "sig": """select user_id record_id, row_number() over (partition by user_id order by ts,event_id)-1 sample_index, value from events""",
    "caps": """select l_returnflag dataset, case when l_linestatus='O' then 'Abnormal' else 'Normal' end binary_label, l_discount>=0.05::double overlap from lineitem""",
    "embs": """select vec_id record_id, vec_id//5 group_id, label, case when label%2=0 then 'even' else 'odd' end binary_label,
 'q'||(label%4) coarse_label, case when (vec_id//5)%10<6 then 'train' when (vec_id//5)%10<8 then 'test2022' else 'test2023' end split,
 embedding::double[] features from embeddings""",
    "embl": "select record_id, split, unnest(range(0,64)) dim, unnest(features) x from embs",
    "etask": """select record_id, group_id, split, 'binary' task, binary_label y from embs union all select record_id, group_id, split, 'coarse', coarse_label from embs""",
    "efit": "select e.*, case when split='train' then fold_id else -1 end fold_id from etask e left join efold using (task, group_id)",
    "ebr": """select record_id, 'all' kind, dim, x from embl union all select record_id, 'single', dim, x*x from embl union all
 select record_id, 'grid', (dim//16)*4+dim%4, avg(x) from embl group by all union all
 select record_id, 'grid', 16+(dim//16)*4+dim%4, stddev_pop(x) from embl group by all""",
    "emeans": """select kind, task, k, y cls, dim, avg(x) m from ebr join efit using (record_id) cross join (select unnest(range(-1,5)) k)
 where split='train' and (k=-1 or fold_id<>k) group by all""",
    "edist": """select kind, task, record_id, cls, 1.0::double/(1.0::double+sqrt(sum((x-m)*(x-m)))) c
 from efit join ebr using (record_id) join emeans using (kind, task, dim) where k=fold_id group by all""",
    "eprob": """select kind, task, record_id, split, y, cls, c/sum(c) over (partition by kind, task, record_id) p
 from edist join etask using (task, record_id)""",
    "ecls": "select distinct task, cls from eprob",
    "etry": """select task, record_id, y, alpha, cls y_pred from (select a.*, alpha, row_number() over (partition by task, a.record_id, alpha
   order by alpha*a.p+(1.0::double-alpha)*b.p desc, cls) rk from eprob a join eprob b using (task, record_id, cls) cross join alphas
   where a.kind='all' and b.kind='grid' and a.split='train') where rk=1""",
    "etryc": """select task, alpha, cls, sum(case when y=cls and y_pred=cls then n else 0 end) tp, sum(case when y=cls then n else 0 end) sup,
 sum(case when y_pred=cls then n else 0 end) prd from (select task, alpha, y, y_pred, count(*) n from etry group by all) join ecls using (task) group by all""",
    "ealpha": """select task, alpha from (select task, alpha, row_number() over (partition by task order by avg(case when sup>0 then tp::double/sup end) desc,
   avg(case when tp=0 then 0.0::double else 2.0::double*(tp::double/prd)*(tp::double/sup)/(tp::double/prd+tp::double/sup) end) desc,
   abs(alpha-0.5), alpha) rk from etryc group by task, alpha) where rk=1""",
    "efinal": """select kind, task, record_id, split, y, cls, p, null::double alpha from eprob where split<>'train' union all
 select 'fused', task, record_id, a.split, a.y, cls, alpha*a.p+(1.0::double-alpha)*b.p, alpha from eprob a join eprob b using (task, record_id, cls)
 join ealpha using (task) where a.kind='all' and b.kind='grid' and a.split<>'train'""",
    "epred": """select kind, task, split, y, y_pred, alpha, count(*) n from (select *, cls y_pred, row_number() over (partition by kind, task, record_id order by p desc, cls) rk
   from efinal) where rk=1 group by all""",
    "emet": """select kind, task, split, alpha, avg(case when sup>0 then tp::double/sup end) balanced_accuracy,
 avg(case when tp=0 then 0.0::double else 2.0::double*(tp::double/prd)*(tp::double/sup)/(tp::double/prd+tp::double/sup) end) macro_f1,
 sum(tp)::double/sum(sup)::double accuracy, sum(sup)::bigint record_count from (select kind, task, split, max(alpha) alpha, cls,
 sum(case when y=cls and y_pred=cls then n else 0 end) tp, sum(case when y=cls then n else 0 end) sup, sum(case when y_pred=cls then n else 0 end) prd
 from epred join ecls using (task) group by kind, task, split, cls) group by all""",
    "ctask": """select record_id, group_id, split, 'T2-1' task, coarse_label y from recs union all select record_id, group_id, split, 'T2-2', fine_label from recs""",
    "cfit": "select e.*, case when split='train2022' then fold_id else -1 end fold_id from ctask e left join cfold using (task, group_id)",
    "cvec": "select record_id, temperature, dim, v x from sdp union all select record_id, -1.0, dim, quantile_cont(x,0.75) from winl group by all",
    "cmeans": """select temperature, task, k, y cls, dim, avg(x) m from cvec join cfit using (record_id) cross join (select unnest(range(-1,5)) k)
 where split='train2022' and (k=-1 or fold_id<>k) group by all""",
    "cdist": """select temperature, task, record_id, split, fold_id, y, cls, 1.0::double/(1.0::double+sqrt(sum((x-m)*(x-m)))) c
 from cfit join cvec using (record_id) join cmeans using (temperature, task, dim) where k=fold_id group by all""",
    "cprob": "select *, c/sum(c) over (partition by temperature, task, record_id) p from cdist",
    "ctry": """select task, temperature, fold_id, y y_true, cls y_pred from (select p.*, row_number() over (partition by p.temperature, task, record_id order by p.p desc, pos) rk
   from cprob p join cl using (task, cls) where split='train2022' and temperature>0) where rk=1""",
    "cscore": f"""select *, (SE+SP)/2 "AS", case when SE+SP=0 then 0.0::double else 2*SE*SP/(SE+SP) end HS,
 ((SE+SP)/2+case when SE+SP=0 then 0.0::double else 2*SE*SP/(SE+SP) end)/2 Score from (select task, temperature, fold_id, count(*) record_count, {SE_SP} from ctry group by all)""",
    "cmean": "select task, temperature, avg(Score) mean_score, row_number() over (partition by task order by temperature) k from cscore group by task, temperature",
    "cwalk": """select task, k, temperature, mean_score from cmean where k=1 union all
 select o.task, o.k, case when o.mean_score>cwalk.mean_score+1e-4::double then o.temperature else cwalk.temperature end,
 case when o.mean_score>cwalk.mean_score+1e-4::double then o.mean_score else cwalk.mean_score end from cwalk join cmean o on o.task=cwalk.task and o.k=cwalk.k+1""",
    "cbest": "select task, max_by(temperature, k) temperature from cwalk group by task",
    "cfinal": """select 'CLS' method, p.* from cprob p join cbest using (task, temperature) union all select 'Temporal Grid', * from cprob where temperature=-1.0""",
    "cboth": """select method, task, record_id, split, y, cls, p from cfinal where split<>'train2022' union all
 select 'Fusion', task, record_id, a.split, a.y, cls, 0.5::double*a.p+0.5::double*b.p from cfinal a join cfinal b using (task, record_id, cls)
 where a.method='CLS' and b.method<>'CLS' and a.split<>'train2022'""",
    "coff": f"""select *, (SE+SP)/2 "AS", case when SE+SP=0 then 0.0::double else 2*SE*SP/(SE+SP) end HS,
 ((SE+SP)/2+case when SE+SP=0 then 0.0::double else 2*SE*SP/(SE+SP) end)/2 Score from (select split evaluation, task, method, count(*) record_count, {SE_SP}
 from (select split, task, method, y y_true, cls y_pred from (select b.*, row_number() over (partition by method, task, record_id order by p desc, pos) rk
   from cboth b join cl using (task, cls)) where rk=1) group by all)""",
    "docs": """select d.doc_id record_id, source group_id, case when d.doc_id%5=0 then 'test' else 'train' end split, sha256(text) content, quality, toxic
 from documents d left join labels l on d.doc_id=l.doc_id""",
    "tpd": "select * from tp where evaluation='test2022'",
    "patients": """select task, group_id, row_number() over (partition by task order by group_id)-1 patient_index, count(*) over (partition by task) patients
 from (select distinct task, group_id from tpd)""",
    "draws": f"""select task, d.range draw, k.patient_index slot,
 ('0x'||substr(md5(concat('boot:',task,':',d.range,':',k.patient_index)),1,15))::bigint % patients patient_index
 from range({REPLICATES}) d cross join patients k""",
    "cells": """select task, method, patient_index, y_true t, y_pred p, count(*) n from tpd join patients using (task, group_id) group by all""",
    "resampled": f"""select draw, task, method, t, p, sum(n)::bigint n from (select draw, task, method, t, p, n from draws join cells using (task, patient_index)
 union all select d.range, task, method, t, p, 0 from range({REPLICATES}) d cross join (select distinct task, method, t, p from cells)) group by all""",
    "resampledp": "select * from resampled union all select -1, task, method, t, p, sum(n)::bigint from cells group by all",
    "rpc": """select draw, task, method, cls, coalesce(sum(case when t=cls and p=cls then n end),0) tp,
 coalesce(sum(case when t=cls then n end),0) sup, coalesce(sum(case when p=cls then n end),0) prd
 from resampledp join cl using (task) group by all""",
    "crepsp": """select draw, task, method, avg(case when sup=0 then 'nan'::double else tp::double/sup end) balanced_accuracy,
 avg(case when sup+prd=0 then 0.0::double else 2.0::double*tp/(sup+prd) end) macro_f1,
 sum(tp)::double/sum(sup)::double accuracy from rpc group by all""",
    "creps": "select * from crepsp where draw>=0",
    "hreps0": """select draw, task, method,
 coalesce(sum(case when t in ('Abnormal','2-HIGH','3-MEDIUM','4-NOT SPECIFIED') and t=p then n end),0)::double
  /sum(case when t in ('Abnormal','2-HIGH','3-MEDIUM','4-NOT SPECIFIED') then n end) SE,
 coalesce(sum(case when t in ('Normal','1-URGENT') and t=p then n end),0)::double/sum(case when t in ('Normal','1-URGENT') then n end) SP
 from resampledp group by all""",
    "hrepsp": """select *, (SE+SP)/2 "AS", case when SE+SP=0 then 0.0::double else 2*SE*SP/(SE+SP) end HS,
 ((SE+SP)/2+case when SE+SP=0 then 0.0::double else 2*SE*SP/(SE+SP) end)/2 Score from hreps0""",
    "hreps": "select * from hrepsp where draw>=0",
    "folded": """select r.*, case when split='train2022' then fold_id::int else -1 end fold_id from recs r left join gfold using (group_id)""",
    "alphas": "select i, i/20.0::double alpha from range(21) t(i)",
    "sweep": """select record_id, y_true, alpha, cls y_pred from (select a.record_id, a.y_true, alpha, a.cls,
   row_number() over (partition by a.record_id, alpha order by alpha*a.p+(1.0::double-alpha)*b.p desc, a.j) rk
   from scores_long a join scores_long b on a.record_id=b.record_id and a.j=b.j and a.method='CLS' and b.method='TG' cross join alphas
   where a.split='train2022') where rk=1""",
    "sweepc": """select alpha, cls, sum(case when y_true=cls and y_pred=cls then n else 0 end) tp, sum(case when y_true=cls then n else 0 end) sup,
 sum(case when y_pred=cls then n else 0 end) prd from (select alpha, y_true, y_pred, count(*) n from sweep group by all) cross join fine group by all""",
    "sweepm": """select alpha, avg(case when sup>0 then tp::double/sup end) balanced_accuracy,
 avg(case when tp=0 then 0.0::double else 2.0::double*(tp::double/prd)*(tp::double/sup)/(tp::double/prd+tp::double/sup) end) macro_f1,
 sum(tp)::double/sum(sup)::double accuracy, sum(sup)::bigint record_count from sweepc group by all""",
    "temps": "select unnest([1.0,2.0,5.0,10.0,20.0,50.0,100.0])::double temperature",
    "tfold": """select temperature, (group_id%5)::int fold_id, y_true, cls y_pred from (select a.record_id, a.group_id, a.y_true, temperature, a.cls,
   row_number() over (partition by a.record_id, temperature order by (1.0::double/temperature)*a.p+(1.0::double-(1.0::double/temperature))*b.p desc, a.j) rk
   from scores_long a join scores_long b on a.record_id=b.record_id and a.j=b.j and a.method='CLS' and b.method='TG' cross join temps
   where a.split='train2022') where rk=1""",
    "tscore0": """select temperature, fold_id,
 sum(case when y_true in ('2-HIGH','3-MEDIUM','4-NOT SPECIFIED') and y_true=y_pred then 1 else 0 end)::double/sum(case when y_true in ('2-HIGH','3-MEDIUM','4-NOT SPECIFIED') then 1 else 0 end) SE,
 sum(case when y_true='1-URGENT' and y_true=y_pred then 1 else 0 end)::double/sum(case when y_true='1-URGENT' then 1 else 0 end) SP from tfold group by all""",
    "tscore": """select *, ((SE+SP)/2+case when SE+SP=0 then 0.0::double else 2*SE*SP/(SE+SP) end)/2 Score from tscore0""",
    "tmean": "select 'T2-2' task, temperature, avg(Score) mean_score from tscore group by all",
    "sdpd": """select w.record_id, w.window_index, sqrt(sum((w.x-c.m)*(w.x-c.m))) d from winl w
 join (select record_id, dim, avg(x) m from winl group by all) c using (record_id, dim) group by all""",
    "sdp": """select record_id, temperature, dim, sum(x*w)/sum(w) v from (select winl.record_id, dim, x, temperature,
   exp((d-max(d) over (partition by winl.record_id, dim, temperature))/temperature) w
   from winl join sdpd using (record_id, window_index) cross join temps) group by all""",
}

DEPENDS = {
    "etask": ("embs",), "efit": ("efold",), "ebr": ("embl",), "emeans": ("ebr", "efit"), "edist": ("emeans",),
    "eprob": ("edist",), "ecls": ("eprob",), "etry": ("eprob", "alphas"), "etryc": ("etry", "ecls"), "ealpha": ("etryc",),
    "efinal": ("ealpha",), "epred": ("efinal",), "emet": ("epred",), "ctask": ("recs",), "cfit": ("cfold",),
    "cvec": ("sdp", "winl"), "cmeans": ("cvec", "cfit"), "cdist": ("cmeans",), "cprob": ("cdist",), "ctry": ("cprob", "cl"),
    "cscore": ("ctry",), "cmean": ("cscore",), "cwalk": ("cmean",), "cbest": ("cwalk",), "cfinal": ("cbest",), "cboth": ("cfinal",),
    "coff": ("cboth",),
    "raws": ("recs", "fine", "meth"), "scores_long": ("raws",), "scores3": ("scores_long",), "pred3": ("scores3",),
    "tp": ("pred3",), "conf": ("tp",), "pc": ("conf", "cl"), "pr": ("pc",), "met": ("pr",), "off0": ("tp",), "off": ("off0",),
    "winl": ("wins",), "embl": ("embs",), "tpd": ("tp",), "patients": ("tpd",), "draws": ("patients",), "cells": ("tpd", "patients"),
    "resampled": ("draws", "cells"), "resampledp": ("resampled",), "rpc": ("resampledp", "cl"), "crepsp": ("rpc",), "creps": ("crepsp",), "hreps0": ("resampledp",),
    "hrepsp": ("hreps0",), "hreps": ("hrepsp",), "folded": ("gfold",), "sweep": ("scores_long", "alphas"),
    "sweepc": ("sweep", "fine"), "sweepm": ("sweepc",), "tfold": ("scores_long", "temps"), "tscore0": ("tfold",),
    "tscore": ("tscore0",), "tmean": ("tscore",), "sdpd": ("winl",), "sdp": ("sdpd", "temps"),
}

for _name, _source in FOLD_SOURCES.items():
    VIEWS |= fold_views(_name, _source)
    _base = {"efold": "etask", "cfold": "ctask", "gfold": "recs"}[_name]
    DEPENDS |= {f"{_name}_cls": (_base,), f"{_name}_vec": (f"{_name}_cls",), f"{_name}_seq": (f"{_name}_vec",), f"{_name}_head": (f"{_name}_seq",),
                f"{_name}_rest": (f"{_name}_head",), _name: (f"{_name}_rest",)}

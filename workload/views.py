"""Shared SQL views over the driver's tables, the counterpart of workload.tables."""

from __future__ import annotations

# name -> (views it reads, statement)
VIEWS: dict[str, tuple[str, str]] = {
    "ev": (
        "",
        """select cast(event_id as varchar) as event_id, cast(user_id as varchar) as user_id,
           json_extract_string(props, '$.k') as item_id, event_type as domain,
           cast(epoch(date_trunc('day', ts)) as bigint) as "timestamp", value from events""",
    ),
    "buy": (
        "",
        """select distinct sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
             cast(round(l_quantity * 100) as bigint), cast(round(l_extendedprice * 100) as bigint),
             cast(round(l_discount * 100) as bigint), cast(round(l_tax * 100) as bigint), l_returnflag, l_linestatus,
             cast(epoch(l_shipdate) as bigint))) as event_id,
           cast(o_custkey as varchar) as user_id, cast(l_partkey as varchar) as item_id, 'retail' as domain,
           cast(epoch(o_orderdate) as bigint) as "timestamp"
           from lineitem join orders on l_orderkey = o_orderkey""",
    ),
    "cat": (
        "",
        """select 'retail' as domain, cast(p_partkey as varchar) as item_id, p_name as title, p_type as category,
           case when p_size <= 40 then 'P' || p_partkey end as answer, p_brand as brand, p_size as size from part""",
    ),
    # history by the direct definition: every earlier event of the user, then the last 20
    "hist": (
        "buy",
        """select b.event_id, b.user_id, b.item_id, b.domain, b."timestamp",
             list_slice(list_filter(u.all_events, lambda x: x.t < b."timestamp"), -20, -1) as history
           from buy b join (select domain, user_id, list({'t': "timestamp", 'e': event_id, 'i': item_id}
                            order by "timestamp", event_id) as all_events from buy group by domain, user_id) u
             using (domain, user_id)""",
    ),
    "ehist": (
        "ev",
        """select b.event_id, b.user_id, b.item_id, b.domain, b."timestamp", b.value,
             list_slice(list_filter(u.all_events, lambda x: x.t < b."timestamp"), -20, -1) as history
           from ev b join (select domain, user_id, list({'t': "timestamp", 'e': event_id, 'i': item_id}
                            order by "timestamp", event_id) as all_events from ev group by domain, user_id) u
             using (domain, user_id)""",
    ),
    "turns": (
        "",
        """select a.conv_id, a.turn, a.text as prompt, b.text as response
           from conversations a left join conversations b
             on a.conv_id = b.conv_id and b.turn = a.turn + 1 and b.role = 'assistant'
           where a.role = 'user'""",
    ),
    "encoded": (
        "turns",
        """select conv_id || ':' || turn as record_id, cast(conv_id as varchar) as root_id, 'chat' as task,
             case when turn = 0 then 'opening' else 'followup' end as domain, 'conversations' as source,
             case when b < 700 then 'train' when b < 800 then 'select' when b < 900 then 'tune'
                  when b < 950 then 'audit' else 'holdout' end as split,
             list_transform(string_split(prompt, ' '), lambda w: cast('0x' || substr(sha256(w), 1, 12) as bigint) % 32000) as prompt_ids,
             case when response is null then [] else
               list_transform(string_split(response, ' '), lambda w: cast('0x' || substr(sha256(w), 1, 12) as bigint) % 32000) end as response_ids,
             'words-32000' as recipe_id,
             'u' || (cast('0x' || substr(sha256('user' || conv_id), 1, 12) as bigint) % 50) as user_id
           from (select *, cast('0x' || substr(sha256(cast(conv_id as varchar)), 1, 12) as bigint) % 1000 as b from turns)""",
    ),
    "sft_all": (
        "encoded",
        """select record_id, root_id, task, domain, source, split, list_concat(prompt_ids, response_ids) as input_ids,
             list_concat(list_transform(prompt_ids, lambda x: -100), response_ids) as labels, recipe_id, user_id,
             cast(len(response_ids) as bigint) as cost, '["' || task || '","' || domain || '"]' as cell
           from encoded""",
    ),
    "sft": ("sft_all", "select * from sft_all where cost > 0 and len(input_ids) >= 2 and split <> 'holdout'"),
    "sft_all_keys": (
        "sft_all",
        """select *, sha256('[[' || array_to_string(input_ids, ',') || '],[' || array_to_string(labels, ',') || '],"'
             || recipe_id || '"]') as content_id,
             sha256('["' || root_id || '","' || task || '","' || domain || '"]') as provenance_group from sft_all""",
    ),
    "sft_keys": ("sft_all_keys", "select * from sft_all_keys where cost > 0 and len(input_ids) >= 2 and split <> 'holdout'"),
    "vec": (
        "",
        """select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as v, label, cast(label as varchar) as cell,
             cast(vec_id // 5 as varchar) as grp, 1 + vec_id % 7 as cost from embeddings""",
    ),
    "vec_long": ("vec", "select id, label, unnest(range(len(v))) as pos, unnest(v) as x from vec"),
    # three objectives: dot products with the first three label centroids less the global centroid
    "target": (
        "vec_long",
        """select c.label, c.pos, c.m - g.m as g from
             (select label, pos, avg(x) as m from vec_long where label < 3 group by label, pos) c
             join (select pos, avg(x) as m from vec_long group by pos) g using (pos)""",
    ),
    "resp": (
        "vec_long target",
        """select v.id, t.label as objective, sum(v.x * t.g) as value
           from vec_long v join target t on v.pos = t.pos group by v.id, t.label""",
    ),
    "wide": (
        "resp",
        """select id, max(case when objective = 0 then value end) as a0, max(case when objective = 1 then value end) as a1,
             max(case when objective = 2 then value end) as a2 from resp group by id""",
    ),
    "base": ("vec", "select id, label, v, cost, 1.0 / count(*) over () as p from vec"),
    "feedback": (
        "",
        """select cast(d.doc_id as varchar) as id, d.lang as scene, cast(l.quality as double) as quality,
             cast(l.toxic as double) as toxic, cast(d.n_chars as double) as n_chars
           from documents d left join labels l using (doc_id)""",
    ),
    "bandit": (
        "",
        """select e.event_id, e.a as action, e.value / 500.0 as reward, s.share as e from
             (select event_id, value, dense_rank() over (order by event_type) as a from events) e
             join (select a, count(*) * 1.0 / sum(count(*)) over () as share from
               (select dense_rank() over (order by event_type) as a from events) group by a) s using (a)""",
    ),
}


def with_views(names: list[str], sql: str) -> str:
    """The statement with the views it needs, in order of dependence."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in VIEWS[name][0].split():
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql
    head = ", ".join(f"{n} as ({VIEWS[n][1]})" for n in ordered)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}"

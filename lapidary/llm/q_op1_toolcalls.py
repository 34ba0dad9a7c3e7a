"""All conversations read as tool use and linked."""

from lapidary.llm.toolcalls import calls_from_turns, link_calls

TOOLS = {
    "reply": {
        "properties": {"text": {"type": "string", "minLength": 20, "maxLength": 4000}, "words": {"type": "integer", "minimum": 5, "maximum": 250}},
        "required": ["text", "words"],
        "additionalProperties": False,
    }
}


def query(spark, sf_dir):
    return link_calls(*calls_from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)


ORACLE = r"""
with recursive m as (select cast(conv_id as bigint) as conv_id, cast(turn as bigint) as turn, role, coalesce(text, '') as text,
                            cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as words from conversations),
c as (select conv_id, 'call-' || turn as call_id, 'call-' || (turn - 2) as after, min(turn) as call_turn, count(*) as n_calls, min(struct_pack(a := '{"text":' || to_json(text) || ',"words":' || words || '}', text := text, words := words)) as x
      from m where role = 'assistant' group by all),
r as (select conv_id, 'call-' || (turn - 1) as call_id, min(turn) as result_turn, count(*) as n_results, min(text) as content from m where role = 'user' and turn > 0 group by all),
d as (select c.conv_id, c.call_id, cast(0 as bigint) as depth from c left join c p on p.conv_id = c.conv_id and p.call_id = c.after where p.call_id is null
      union all select c.conv_id, c.call_id, d.depth + 1 from d join c on c.conv_id = d.conv_id and c.after = d.call_id),
j as (select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, depth, call_turn, result_turn,
             coalesce(n_calls, 0) as n_calls, coalesce(n_results, 0) as n_results, x, content,
             case when c.call_id is null then '' else array_to_string(list_filter([
               case when length(x.text) > 4000 then 'text: maxLength' end, case when length(x.text) < 20 then 'text: minLength' end,
               case when x.words > 250 then 'words: maximum' end, case when x.words < 5 then 'words: minimum' end], lambda e: e is not null), '; ') end as errors
      from c full join r on r.conv_id = c.conv_id and r.call_id = c.call_id left join d on d.conv_id = c.conv_id and d.call_id = c.call_id)
select conv_id, call_id, depth, call_turn, result_turn, n_calls, n_results,
       case when n_calls = 0 then 'orphan' when depth is null then 'cycle' when errors <> '' then 'invalid' when n_results = 0 then 'unanswered' else 'ok' end as status, errors,
       '{' || array_to_string(list_filter([case when n_calls > 0 then '"arguments":' || x.a end, '"call_id":' || to_json(call_id),
         case when n_calls > 0 then '"name":"reply"' end, case when n_results > 0 then '"result":' || to_json(content) end], lambda e: e is not null), ',') || '}' as json
from j
"""

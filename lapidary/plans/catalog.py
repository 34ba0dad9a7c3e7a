"""Registry of the operators as runnable queries over the carrier tables, with their DuckDB statements.

The carriers are in Latin script, so rule vocabularies are passed as parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import paths as P
from lapidary.functions import text as X
from lapidary.operators import dedup, inventory, joins, jsonx, prompts, similarity, tables
from lapidary.operators.rules import Rules, Vocabulary, kept_and_rejected, route
from lapidary.schema import records_from_json
from lapidary.sources import sinks

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function with its DuckDB statement."""

    def put(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return put


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- rules on documents

LATIN = Vocabulary(
    empty_answers=("", "the", "la"), empty_questions=("",), listening="th", listening_with=("on the", "de la"), picture_marks=("@mail",), picture_words=("+1 (",),
    underline_words=("###", "***"), no_answer="no answer", no_question="no question", is_listening="listening", has_picture="picture", has_table="table",
    has_underline="underline", options_missing="options", too_short="short", unknown_source="unknown source",
)
LATIN_ROUTES = (("en", "english"), ("de", "politics"), ("fr", "history"), ("es", "chinese"))


def tokens_sql(column: str) -> str:
    """Chinese runs become signs of their own, which are taken off again; their characters count by the mean word."""
    other = rf"len(regexp_extract_all(regexp_replace({column}, '\p{{Han}}+', chr(1), 'g'), '[\p{{L}}\p{{N}}]+|\s|[^\p{{L}}\p{{N}}\s]'))"
    return rf"({other} - len(regexp_extract_all({column}, '\p{{Han}}+')) + cast(ceil(len(regexp_extract_all({column}, '\p{{Han}}')) / {X.HAN_PER_WORD}) as bigint))"



def document_records(spark, sf_dir: str) -> DataFrame:
    """Documents as standalone records: the text is the question, its first word the answer."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("source_type"), F.col("source").alias("section"), F.col("text").alias("question"), F.regexp_extract(F.lower("text"), "^(\\S*)", 1).alias("answer"),
        F.lit("").alias("background"), F.lit(False).alias("has_sub_qa"), F.lit(None).cast("array<struct<number string, question string, answer string>>").alias("sub_qa"), F.col("text").alias("raw"),
        *(none.alias(c) for c in ("bg_picture", "bg_table", "bg_underline")),
    )


_RULES_SQL = rf"""
with r as (select doc_id as seq, lang, source as section, text as q, regexp_extract(lower(text), '^(\S*)', 1) as a from documents),
h as (select *, contains(q, '@mail') or contains(q, '+1 (') or contains(a, '+1 (') as pic, q = '' as no_q,
             contains(q, 'th') and (contains(q, 'on the') or contains(q, 'de la')) as listening, contains(a || q, '###') or contains(a || q, '***') as underline,
             {tokens_sql("q")} as tokens, a in ('', 'the', 'la') as no_a,
             upper(regexp_replace(a, '[\s,、，]+', '', 'g')) as n from r),
e as (select seq, section, lang, case
        when lang = 'en' then case when pic then 'picture' when no_q then 'no question' when listening then 'listening' when tokens < 20 then 'short' when no_a then 'no answer' end
        when lang = 'de' then case when pic then 'picture' when no_q then 'no question' when no_a then 'no answer' end
        when lang = 'fr' then case when pic then 'picture' when no_q then 'no question' when underline then 'underline' when no_a then 'no answer' end
        when lang = 'es' then case when pic then 'picture' when no_q then 'no question' when underline then 'underline'
          when regexp_matches(n, '^[A-Z]+$') and len(list_distinct(string_split(n, ''))) = length(n) and not (regexp_matches(q, '[Aa]\s*([一-龥]|[^\p{{L}}\p{{N}}_\s])') and
            regexp_matches(q, '[Bb]\s*([一-龥]|[^\p{{L}}\p{{N}}_\s])') and regexp_matches(q, '[Cc]\s*([一-龥]|[^\p{{L}}\p{{N}}_\s])') and regexp_matches(q, '[Dd]\s*([一-龥]|[^\p{{L}}\p{{N}}_\s])')) then 'options'
          when tokens < 10 then 'short' when no_a then 'no answer' end
        else 'unknown source' end as err_type from h)
"""


def routed(spark, sf_dir: str) -> DataFrame:
    return route(document_records(spark, sf_dir), Rules(LATIN), LATIN_ROUTES)


@query("rule_reason_counts", _RULES_SQL + "select section as source, coalesce(err_type, 'kept') as err_type, count(*) as n from e group by all")
def rule_reason_counts(spark, sf_dir):
    return routed(spark, sf_dir).groupBy(F.col("section").alias("source"), F.coalesce("err_type", F.lit("kept")).alias("err_type")).agg(F.count("*").alias("n"))


@query("rule_first_hit", _RULES_SQL + "select seq, lang, err_type from e")
def rule_first_hit(spark, sf_dir):
    return routed(spark, sf_dir).select("seq", F.col("source_type").alias("lang"), "err_type")


@query("reject_channel", _RULES_SQL + "select seq, err_type from e where err_type is not null")
def reject_channel(spark, sf_dir):
    return kept_and_rejected(routed(spark, sf_dir))[1].select("seq", "err_type")


@query("kept_channel", _RULES_SQL + "select seq from e where err_type is null")
def kept_channel(spark, sf_dir):
    return kept_and_rejected(routed(spark, sf_dir))[0].select("seq")


def _one_rule(name: str, make, condition: str):
    @query(name, f"with r as (select doc_id as seq, text as q, regexp_extract(lower(text), '^(\\S*)', 1) as a from documents) select seq, coalesce({condition}, false) as hit from r")
    def run(spark, sf_dir):
        return document_records(spark, sf_dir).select("seq", make(Rules(LATIN)).hit.alias("hit"))

    return run


_one_rule("empty_answer_filter", lambda r: r.empty_answer(), "a in ('', 'the', 'la')")
_one_rule("empty_question_filter", lambda r: r.empty_question(), "q = ''")
_one_rule("listening_filter", lambda r: r.listening(), "contains(q, 'th') and (contains(q, 'on the') or contains(q, 'de la'))")
_one_rule("picture_filter", lambda r: r.picture(), "contains(q, '@mail') or contains(q, '+1 (')")
_one_rule("underline_filter", lambda r: r.underline(strict=False), "contains(a || q, '###') or contains(a || q, '***')")
_one_rule("short_filter", lambda r: r.short(60), tokens_sql("q") + " < 60")


@query("table_flag_filter", "select doc_id as seq, lang = 'de' as hit from documents")
def table_flag_filter(spark, sf_dir):
    flagged = document_records(spark, sf_dir).withColumn("bg_table", F.when(F.col("source_type") == "de", "是").otherwise("否"))
    return flagged.select("seq", Rules(LATIN).table().hit.alias("hit"))


@query("token_counts", f"select doc_id, {tokens_sql('text')} as tokens, {tokens_sql('mixed')} as mixed from (select *, source || '中文词语' || lang || '，加点字' || doc_id || '中' as mixed from documents)")
def token_counts(spark, sf_dir):
    mixed = F.concat("source", F.lit("中文词语"), "lang", F.lit("，加点字"), F.col("doc_id").cast("string"), F.lit("中"))
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count("text").alias("tokens"), X.token_count(mixed).alias("mixed"))


@query("answer_normalise", r"select p_partkey, upper(regexp_replace(p_name, '[\s,、，]+', '', 'g')) as answer from part")
def answer_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.normalise_answer("p_name").alias("answer"))


_LETTERS = "upper(regexp_extract(lower(text), '^([a-z]*)', 1))"


@query("pure_letter_answer", f"select doc_id, regexp_matches({_LETTERS}, '^[A-Z]+$') and len(list_distinct(string_split({_LETTERS}, ''))) = length({_LETTERS}) as pure from documents")
def pure_letter_answer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.is_pure_letter_answer(F.regexp_extract(F.lower("text"), "^([a-z]*)", 1)).alias("pure"))


@query("option_complete", "select doc_id, " + " and ".join(rf"regexp_matches(text, '[{c}{c.lower()}]\s*([一-龥]|[^\p{{L}}\p{{N}}_\s])')" for c in "ABCD") + " as complete from documents")
def option_complete(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.has_complete_options("text").alias("complete"))


# ---------------------------------------------------------------- nested records from conversations


def nested_records(spark, sf_dir: str) -> DataFrame:
    """Conversations as shared records: the system turn is the background, a user turn with the next assistant turn a part."""
    turns = table(spark, sf_dir, "conversations")
    entry = F.struct("turn", "role", "text")
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    following = F.zip_with("turns", F.concat(F.slice("turns", F.lit(2), F.size("turns")), F.array(F.lit(None).cast("struct<turn:bigint,role:string,text:string>"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(following, lambda p: (p["a"]["role"] == "user") & (p["b"]["role"] == "assistant"))
    background = F.filter("turns", lambda t: t["role"] == "system")
    return grouped.select(
        F.col("conv_id").alias("seq"),
        F.coalesce(F.try_element_at(background, F.lit(1))["text"], F.lit("")).alias("background"),
        F.transform(pairs, lambda p, i: F.struct((i + 1).cast("string").alias("number"), p["a"]["text"].alias("question"), p["b"]["text"].alias("answer"))).alias("sub_qa"),
        F.lit(True).alias("has_sub_qa"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"),
    )


_NESTED_SQL = r"""
with t as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn, role, text)),
p as (select conv_id, row_number() over (partition by conv_id order by turn) as number, text as question, next_text as answer from t where role = 'user' and next_role = 'assistant'),
b as (select conv_id, coalesce(arg_min(text, turn) filter (role = 'system'), '') as background from conversations group by all)
"""


@query("nested_build", _NESTED_SQL + "select b.conv_id as seq, length(background) as background_chars, count(p.number) as parts, coalesce(cast(sum(length(question) + length(answer)) as bigint), 0) as chars from b left join p using (conv_id) group by all")
def nested_build(spark, sf_dir):
    chars = F.aggregate("sub_qa", F.lit(0).cast("long"), lambda a, s: a + F.length(s["question"]) + F.length(s["answer"]))
    return nested_records(spark, sf_dir).select("seq", F.length("background").cast("long").alias("background_chars"), F.size("sub_qa").cast("long").alias("parts"), chars.alias("chars"))


@query("nested_exists_filter", _NESTED_SQL + f"select conv_id as seq, coalesce(bool_or({tokens_sql('background')} + {tokens_sql('question')} < 60), false) as hit from b left join p using (conv_id) group by all")
def nested_exists_filter(spark, sf_dir):
    return nested_records(spark, sf_dir).select("seq", Rules(LATIN).short(40).hit.alias("hit"))


_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_S = lambda c: _STRIP.format(c=c)


def _qa_query(name: str, kind: str, question: str, answer: str):
    # string_agg skips nulls, so empty lines vanish
    sql = _NESTED_SQL + (
        f"select b.conv_id as seq, coalesce(array_to_string(list_filter([nullif({_S('background')}, '')] || list(nullif({question}, '') order by number), lambda x: x is not null), chr(10)), '') as q, "
        f"coalesce(string_agg(nullif({answer}, ''), chr(10) order by number), '') as a from b join p using (conv_id) group by b.conv_id, background"
    )

    @query(name, sql)
    def run(spark, sf_dir):
        q, a = X.qa_texts(kind, "Q")
        return nested_records(spark, sf_dir).where(F.size("sub_qa") > 0).select("seq", q.alias("q"), a.alias("a"))

    return run


_qa_query("qa_text_v1", "check", f"'Q' || number || '  ' || {_S('question')}", f"'Q' || number || '  ' || {_S('answer')}")
_qa_query("qa_text_v2", "image", _S("question"), _S("answer"))
_qa_query("qa_text_v3", "platform", f"'Q' || number || chr(10) || {_S('question')}", f"'Q' || number || chr(10) || {_S('answer')}")


@query("split_qa_stats", _NESTED_SQL + ", n as (select conv_id, count(p.number) as parts from b left join p using (conv_id) group by all) select cast((select count(*) from n) as bigint) as total, (select count(*) from n) - count(*) as dropped, count(*) as kept, cast(sum(greatest(parts, 1)) as bigint) as questions from n where parts > 0")
def split_qa_stats(spark, sf_dir):
    records = nested_records(spark, sf_dir)
    return dedup.stats(records.where(F.size("sub_qa") > 0), records.count())


@query("answer_keys", _NESTED_SQL + f"select conv_id as seq, md5(string_agg({_S('answer')}, '|' order by number)) as key_hash from p group by all")
def answer_keys(spark, sf_dir):
    return nested_records(spark, sf_dir).where(F.size("sub_qa") > 0).select("seq", F.md5(joins.answer_key()).alias("key_hash"))


@query("positional_join", "with u as (select conv_id, turn, row_number() over (partition by conv_id order by turn, text) as nth from conversations where role = 'user'), a as (select conv_id, turn, row_number() over (partition by conv_id order by turn, text) as nth from conversations where role = 'assistant') select u.conv_id, cast(u.nth as integer) as nth, u.turn as user_turn, a.turn as assistant_turn from u join a using (conv_id, nth)")
def positional_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    paired = joins.positional_join(turns.where("role = 'user'"), turns.where("role = 'assistant'"), "conv_id", ["turn", "text"])
    return paired.select("conv_id", "nth", F.col("left.turn").alias("user_turn"), F.col("right.turn").alias("assistant_turn"))


@query("positional_join_stats", "with u as (select conv_id, row_number() over (partition by conv_id order by turn) as nth from conversations where role = 'user'), a as (select conv_id, row_number() over (partition by conv_id order by turn) as nth from conversations where role = 'assistant') select count(*) filter (u.nth is not null and a.nth is not null) as matched, count(*) filter (a.nth is null) as left_only, count(*) filter (u.nth is null) as right_only from u full join a on u.conv_id = a.conv_id and u.nth = a.nth")
def positional_join_stats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return joins.pairing_stats(joins.positional_join(turns.where("role = 'user'"), turns.where("role = 'assistant'"), "conv_id", ["turn"], "full"))


@query("neighbour_window", "with c as (select conv_id, list('p' || turn order by turn, role) as pages, count(*) as n from conversations group by all) select conv_id, array_to_string(pages[1:5], ',') as third, case when n >= 1 then array_to_string(pages[1:3], ',') else '' end as first, case when n >= 20 then 'x' else '' end as outside from c where n >= 3")
def neighbour_window(spark, sf_dir):
    pages = tables.collected(table(spark, sf_dir, "conversations").withColumn("p", F.concat(F.lit("p"), F.col("turn").cast("string"))), ["conv_id"], "p", ["turn", "role"], "pages")
    window = lambda n: F.array_join(P.neighbours(F.col("pages"), F.lit(n)), ",")
    return pages.where(F.size("pages") >= 3).select("conv_id", window(3).alias("third"), window(1).alias("first"), window(99).alias("outside"))


@query("neighbour_union", "with c as (select conv_id, list('p' || turn order by turn, role) as pages, count(*) as n from conversations group by all) select conv_id, array_to_string(pages[1:5], ',') as images from c where n >= 3")
def neighbour_union(spark, sf_dir):
    pages = tables.collected(table(spark, sf_dir, "conversations").withColumn("p", F.concat(F.lit("p"), F.col("turn").cast("string"))), ["conv_id"], "p", ["turn", "role"], "pages")
    return pages.where(F.size("pages") >= 3).select("conv_id", F.array_join(P.neighbours_of_all(F.col("pages"), F.array(F.lit(1), F.lit(3), F.lit(0))), ",").alias("images"))


# ---------------------------------------------------------------- inventory


@query("page_orders", "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey limit 10 offset 30")
def page_orders(spark, sf_dir):
    return tables.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 3, 10)


@query("page_totals", "select count(*) as total_elements, cast(ceil(count(*) / 10.0) as bigint) as total_pages from orders")
def page_totals(spark, sf_dir):
    return tables.page_totals(table(spark, sf_dir, "orders"), 10)


@query("lookup_pk", "select p_partkey, p_name from part where p_partkey = 17")
def lookup_pk(spark, sf_dir):
    return joins.lookup_all(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 17, "p_partkey")


_FIRST = "(select min(p_brand) from part)"


@query("lookup_or", "select p_partkey from part where p_name = 'Brand#11' or p_brand = 'Brand#11' or p_type = 'Brand#11'")
def lookup_or(spark, sf_dir):
    return joins.lookup_all(table(spark, sf_dir, "part"), "Brand#11", "p_name", "p_brand", "p_type").select("p_partkey")


@query("lookup_or_ci", "select p_partkey from part where lower(p_name) = 'brand#11' or lower(p_brand) = 'brand#11' or lower(p_type) = 'brand#11'")
def lookup_or_ci(spark, sf_dir):
    return joins.lookup_all(table(spark, sf_dir, "part"), "bRAND#11", "p_name", "p_brand", "p_type", collation="UNICODE_CI_AI_RTRIM").select("p_partkey")


@query("next_id", "select cast(coalesce(max(p_partkey), 0) + 1 as bigint) as next_id from part")
def next_id(spark, sf_dir):
    return inventory.next_id(table(spark, sf_dir, "part"), "p_partkey")


@query("top1_desc", "select o_orderkey, o_orderstatus from orders order by o_orderkey desc limit 1")
def top1_desc(spark, sf_dir):
    return inventory.newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("formatted_id", "select p_partkey, printf('%07d', p_partkey) as id from part")
def formatted_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.formatted_id("p_partkey").alias("id"))


@query("formatted_time", "select o_orderkey, coalesce(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '') as t from orders")
def formatted_time(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.formatted_time("o_orderdate").alias("t"))


@query("label_text", "select p_partkey, 'name: ' || coalesce(p_name, 'null') || chr(10) || 'brand: ' || coalesce(p_brand, 'null') || chr(10) || 'size: ' || coalesce(cast(p_size as varchar), 'null') as label from part")
def label_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.label_text({"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size")}).alias("label"))


@query("default_image", "select p_partkey, case when p_size % 2 = 0 then '/img/' || p_brand || '.png' else p_name end as image from part")
def default_image(spark, sf_dir):
    given = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", X.default_image(given, "p_brand").alias("image"))


@query("basename", "select page_id, string_split(url, '/')[-1] as name from pages")
def basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.base_name("url").alias("name"))


@query("dto_projection", "select printf('%07d', p_partkey) as id, p_name, p_brand, p_type, p_size from part")
def dto_projection(spark, sf_dir):
    return table(spark, sf_dir, "part").select(X.formatted_id("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size")


@query("upsert", "select c_custkey, case when c_custkey % 7 = 0 then 'CHANGED' else c_name end as c_name, case when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer union all select c_custkey + 1000000, c_name, c_acctbal from customer where c_custkey % 11 = 0")
def upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = rows.where("c_custkey % 7 = 0").select("c_custkey", F.lit("CHANGED").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = rows.where("c_custkey % 11 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return inventory.upsert(rows, changed.union(new), "c_custkey")


@query("delete_by_key", "select c_custkey, c_name from customer where c_custkey % 5 <> 0")
def delete_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return inventory.delete(rows, rows.where("c_custkey % 5 = 0"), "c_custkey")


# ---------------------------------------------------------------- subjects and prompts

_SUBJECTS = [("src1", "alpha"), ("src2", "beta"), ("src", "gamma")]
_TEMPLATE = "Subject {subject}: {{check}} {query} / {answer} / {check_rules}"


@query("subject_router", "select doc_id, case when contains(source, 'src1') then 'alpha' when contains(source, 'src2') then 'beta' when contains(source, 'src') then 'gamma' end as subject from documents")
def subject_router(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_hit("source", _SUBJECTS).alias("subject"))


def _config(spark) -> DataFrame:
    return spark.createDataFrame([("alpha", "types A", "", "rules $1 \\ {x}"), ("beta", "types B", "", "rules B")], "subject string, question_types string, extract_qa_rules string, check_rules string")


@query("config_join", "with s as (select doc_id, case when contains(source, 'src1') then 'alpha' when contains(source, 'src2') then 'beta' else 'gamma' end as subject from documents) select doc_id, subject, case subject when 'alpha' then 'types A' when 'beta' then 'types B' end as question_types, subject = 'gamma' as rejected from s")
def config_join(spark, sf_dir):
    known, unknown = joins.config_join(subject_router(spark, sf_dir), _config(spark), "subject")
    return tables.merged(known.select("doc_id", "subject", "question_types", F.lit(False).alias("rejected")), unknown.withColumn("rejected", F.lit(True)))


@query("prompt_check", r"with s as (select doc_id, text, lang, case when contains(source, 'src1') then 'alpha' else 'beta' end as subject from documents where contains(source, 'src1') or contains(source, 'src2')) select doc_id, md5('Subject ' || subject || ': {check} ' || text || ' / ' || case when lang = 'en' then 'none' else lang end || ' / ' || case subject when 'alpha' then 'rules $1 \ {x}' else 'rules B' end) as prompt from s")
def prompt_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("subject", X.first_hit("source", _SUBJECTS))
    known, _ = joins.config_join(docs, _config(spark), "subject")
    answer = prompts.answer_or_none(F.col("lang"), F.when(F.col("lang") == "en", "x/only_q/y").otherwise("x"), none="none")
    text = prompts.Prompts({"check": _TEMPLATE, "check_special": _TEMPLATE, "check_language": _TEMPLATE}).check(F.col("subject"), F.col("text"), answer, F.col("check_rules"))
    return known.select("doc_id", F.md5(text).alias("prompt"))


@query("verdict_parse", "select doc_id, case when quality = 1 then '是' else '否' end as usable, case when toxic = 1 then '有害' else '' end as reason from labels")
def verdict_parse(spark, sf_dir):
    usable, reason = F.when(F.col("quality") == 1, "是").otherwise("否"), F.when(F.col("toxic") == 1, "，【原因】: 有害").otherwise("")
    verdicts = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("【题目是否可用】： "), usable, reason).alias("v"))
    return verdicts.select("doc_id", X.verdict_field("v", "题目是否可用").alias("usable"), X.verdict_field("v", "原因").alias("reason"))


# ---------------------------------------------------------------- collecting, ordering, numbering


@query("group_collect_sorted", "select l_orderkey, array_to_string(list(l_partkey order by l_partkey), ',') as parts from lineitem group by all")
def group_collect_sorted(spark, sf_dir):
    return tables.collected(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", name="parts").select("l_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


@query("section_order", "select doc_id, lang, source, cast(row_number() over (partition by lang, source order by doc_id % 7, doc_id) as integer) as nth from documents")
def section_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("image", F.concat(F.lit("a/image"), F.format_string("%05d", F.col("doc_id") % 7), F.lit("A.png")))
    order = Window.partitionBy("lang", "source").orderBy(P.image_number("image"), "doc_id")
    return docs.select("doc_id", "lang", "source", F.row_number().over(order).alias("nth"))


@query("dup_name_suffix", "with p as (select page_id, string_split(url, '/')[4] || '.jpg' as name from pages), n as (select *, row_number() over (partition by lower(name) order by page_id) - 1 as nth from p) select page_id, case when nth = 0 then name else regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || '_' || nth || regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 2) end as new_name from n".replace("\\\\", "\\"))
def dup_name_suffix(spark, sf_dir):
    names = table(spark, sf_dir, "pages").select("page_id", F.concat(F.element_at(F.split("url", "/"), 4), F.lit(".jpg")).alias("name"))
    return tables.name_numbers(names, "name", "page_id").select("page_id", "new_name")


@query("first_wins", "select min(p_partkey) as p_partkey, p_name from part group by p_name")
def first_wins(spark, sf_dir):
    return tables.first_of(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("priority_choice", "select source, arg_min(lang, case lang when 'de' then 1 when 'fr' then 2 else 3 end) as lang from (select distinct source, lang from documents where lang in ('de', 'fr', 'en')) group by source")
def priority_choice(spark, sf_dir):
    return tables.by_priority(table(spark, sf_dir, "documents").select("source", "lang").distinct(), "source", "lang", ["de", "fr", "en"])


# ---------------------------------------------------------------- sets


@query("set_reconcile", "select doc_id, 'unlabelled' as side from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'both' from documents where doc_id in (select doc_id from labels)")
def set_reconcile(spark, sf_dir):
    left, right, both = tables.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return tables.merged(left.withColumn("side", F.lit("unlabelled")), right.withColumn("side", F.lit("unknown")), both.withColumn("side", F.lit("both")))


@query("coverage", "select count(distinct d.doc_id) as referenced, (select count(distinct doc_id) from labels) as physical, count(distinct l.doc_id) as found, count(distinct d.doc_id) - count(distinct l.doc_id) as missing, cast(0 as bigint) as unreferenced, round(100.0 * count(distinct l.doc_id) / count(distinct d.doc_id), 2) as coverage from documents d left join labels l using (doc_id)")
def coverage(spark, sf_dir):
    return tables.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("existence", "select doc_id, doc_id in (select doc_id from labels) as found from documents")
def existence(spark, sf_dir):
    found, missing = joins.existing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    return tables.merged(found.withColumn("found", F.lit(True)), missing.withColumn("found", F.lit(False)))


@query("union_distinct_sources", "select source from documents union select lang from documents union select '未知'")
def union_distinct_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("source").union(docs.select("lang")).union(spark.createDataFrame([("未知",)], "source string")).distinct()


@query("merge_union_all", "select doc_id, text, source from documents union all select null, text, null from benchmark")
def merge_union_all(spark, sf_dir):
    return tables.merged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "benchmark").select("text"))


@query("kind_rollup", "select coalesce(lang, 'total') as kind, count(*) as n from documents group by rollup (lang)")
def kind_rollup(spark, sf_dir):
    return tables.kind_totals(table(spark, sf_dir, "documents"), "lang")


@query("distinct_names", "select distinct lower(trim(name)) as name from (select unnest(string_split(source || ';' || upper(lang) || '; ', ';')) as name from documents) where trim(name) <> ''")
def distinct_names(spark, sf_dir):
    return tables.distinct_names(table(spark, sf_dir, "documents").select(F.concat("source", F.lit(";"), F.upper("lang"), F.lit("; ")).alias("pic")), "pic")


@query("source_or_unknown", "select case when doc_id % 9 = 0 then '未知' else source end as source_type, count(*) as n from documents group by all")
def source_or_unknown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("source")).alias("source_type"))
    return sinks.with_source(docs).groupBy("source_type").agg(F.count("*").alias("n"))


@query("missing_report", "select printf('%d. %s', row_number() over (order by source), source) as line from (select distinct source from documents)")
def missing_report(spark, sf_dir):
    return tables.missing_report(table(spark, sf_dir, "documents").select("source").distinct(), "source")


# ---------------------------------------------------------------- paths

_SEGMENTS = "list_filter(string_split(url, '/'), lambda x: x <> '')"


@query("url_parent_distinct", f"select distinct array_to_string({_SEGMENTS}[1:greatest(len({_SEGMENTS}) - 2, 0)], '/') as parent from pages")
def url_parent_distinct(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(P.drop_last("url").alias("parent")).distinct()


@query("path_segments", f"select page_id, {_SEGMENTS}[-3] as third_last, {_SEGMENTS}[-1] as last from pages")
def path_segments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.from_end("url", 3).alias("third_last"), P.from_end("url", 1).alias("last"))


@query("url_distinct", "select distinct url from pages")
def url_distinct(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url").distinct()


@query("image_numbers", "select doc_id, cast(doc_id as bigint) as dashed, cast(doc_id as bigint) as named, cast(0 as bigint) as neither from documents")
def image_numbers(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    made = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a-b/c-"), key, F.lit(".x.png")).alias("d"), F.concat(F.lit("z/image"), F.lpad(key, 8, "0"), F.lit("A-b.png")).alias("n"))
    return made.select("doc_id", P.image_number("d").alias("dashed"), P.image_number("n").alias("named"), P.image_number(F.lit("x/abc-def.png")).alias("neither"))


@query("safe_names", r"select distinct p_name, replace(rtrim(regexp_replace(p_name || ' (' || p_type || ') ', '[^\p{L}\p{N} _-]', '', 'g')), ' ', '_') as name from part")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name", P.safe_name(F.concat("p_name", F.lit(" ("), "p_type", F.lit(") "))).alias("name")).distinct()


@query("copy_manifest", f"select url as src, '/out/' || array_to_string({_SEGMENTS}[-2:], '/') as dst from pages")
def copy_manifest(spark, sf_dir):
    return sinks.copy_plan(table(spark, sf_dir, "pages"), "url", "/out")


# ---------------------------------------------------------------- de-duplication


@query("exact_dedup_keep_latest", "select doc_id, lang from documents qualify row_number() over (partition by lang, md5(text) order by doc_id desc) = 1")
def exact_dedup_keep_latest(spark, sf_dir):
    return dedup.keep_latest(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", "doc_id", ["lang"]).select("doc_id", "lang")


@query("md5_bucket", "select substr(md5(text), 1, 8) as bucket, count(*) as n from documents group by all")
def md5_bucket(spark, sf_dir):
    return dedup.bucket_sizes(table(spark, sf_dir, "documents"), "text")


@query("candidate_window", "select doc_id, array_to_string(list(doc_id) over (partition by lang, source order by doc_id rows between 10 preceding and 1 preceding), ',') as recent from documents")
def candidate_window(spark, sf_dir):
    rows = dedup.recent_before(table(spark, sf_dir, "documents"), "doc_id", "doc_id", ["lang", "source"], nulls_last=True)
    return rows.select("doc_id", F.when(F.size("recent") > 0, F.array_join(F.transform("recent", lambda x: x.cast("string")), ",")).alias("recent"))


def passage_hits(docs: DataFrame, passages: DataFrame, words: int = 8) -> DataFrame:
    """Documents that contain a whole passage: an equi-join on the passage's words behind the first, then a test.

    Other characters may be glued to a passage's first and last word, not to those between.
    Passages without enough words between are tested against each document.
    """
    split = lambda c: F.filter(F.split(c, "\\s+"), lambda x: x != "")
    known = passages.select("item_id", F.col("text").alias("_passage"), split("text").alias("_w"))
    heads = known.where(F.size("_w") >= words + 2).select("item_id", "_passage", F.xxhash64(F.array_join(F.slice("_w", 2, words), " ")).alias("_head"))
    grams = docs.select("doc_id", "text", split("text").alias("_w")).where(F.size("_w") >= words)
    spots = F.transform(F.sequence(F.lit(1), F.size("_w") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, words), " ")))
    found = grams.select("doc_id", F.explode(F.array_distinct(spots)).alias("_head")).join(heads, "_head").select("doc_id", "item_id", "_passage").distinct()
    long = docs.join(found, "doc_id").where(F.contains("text", F.col("_passage"))).select("doc_id", "item_id")
    few = known.where(F.size("_w") < words + 2).select("item_id", "_passage")
    short = docs.join(F.broadcast(few), F.contains("text", F.col("_passage"))).select("doc_id", "item_id")
    return long.union(short).distinct()


@query("corpus_overlap_exact", r"select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) where len(list_filter(regexp_split_to_array(b.text, '\s+'), lambda x: x <> '')) >= 8")
def corpus_overlap_exact(spark, sf_dir):
    return passage_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("near_dup_pairs")
def near_dup_pairs(spark, sf_dir):
    """Pairs of rows in a language whose texts are duplicates by ratio or partial ratio: a row with the ten before it, and
    with the first row of its text, whatever the distance. ``partial`` is null below 80.

    Through its first row a text's rows are all linked, without a pair for every two of them.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")

    def scored(row: dict, before: list[dict]) -> list[dict]:
        scores = {t: similarity.duplicate_scores(row["text"], t) for t in {r["text"] for r in before}}
        found = [(r["doc_id"], scores[r["text"]]) for r in before]
        return [{"doc_id": row["doc_id"], "other_id": other, "ratio": s[0], "partial": s[1]} for other, s in found if s is not None]

    near = dedup.map_recent(docs, ["doc_id", "text"], ["lang"], scored, "doc_id long, other_id long, ratio double, partial double")
    near = near.select("doc_id", "other_id", F.round("ratio", 6).alias("ratio"), F.round("partial", 6).alias("partial"))
    keys = docs.select("doc_id", "lang", F.md5("text").alias("key"))
    first = keys.groupBy("lang", "key").agg(F.min("doc_id").alias("other_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    equal = keys.join(first, ["lang", "key"]).where("doc_id > other_id").select("doc_id", "other_id", F.lit(100.0).alias("ratio"), F.lit(100.0).alias("partial"))
    return near.union(equal).distinct()


@query("dedup_state_machine")
def dedup_state_machine(spark, sf_dir):
    """The order-dependent decisions over the whole texts of documents, language by language: each is a standalone record."""
    docs = table(spark, sf_dir, "documents")
    questions = docs.select("lang", F.col("doc_id").alias("seq"), F.col("text").alias("question"), F.lit("").alias("background"), F.lit(None).cast("array<string>").alias("sub_questions"))
    return dedup.fuzzy_decisions(questions, ["lang"])


# ---------------------------------------------------------------- JSON


@query("json_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("json_extract_objects", "select event_id, n as position, json_extract_string(props, '$.k') as k from (select event_id, props, unnest([0, 1]) as n from events)")
def json_extract_objects(spark, sf_dir):
    text = F.concat(F.lit("first ```json\n"), F.col("props"), F.lit("\n``` then "), F.col("props"), F.lit(" end"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("answer"))
    found = jsonx.extract_objects(rows, "answer", keys=("k",))
    return found.select("event_id", "position", F.get_json_object("value", "$.k").alias("k"))


@query("json_repair", "select event_id, json_extract_string(props, '$.k') as k from events")
def json_repair(spark, sf_dir):
    broken = F.concat(F.lit("x {'k': "), F.get_json_object("props", "$.k"), F.lit(' "z": 1} y'))
    rows = table(spark, sf_dir, "events").select("event_id", broken.alias("answer"))
    found = jsonx.extract_objects(rows, "answer", keys=("k",))
    return found.select("event_id", F.get_json_object("value", "$.k").alias("k"))


@query("json_without_objects", "select event_id from events where event_id % 3 <> 0")
def json_without_objects(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("nothing here").alias("answer"))
    return jsonx.without_objects(rows, jsonx.extract_objects(rows, "answer", keys=("k",)), "event_id")


@query("records_from_json", "select doc_id, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '' else lang end as answer, doc_id % 5 = 0 as has_sub_qa, doc_id % 6 = 0 as corrupt from documents where doc_id % 6 <> 0 union all select doc_id, '', false, true from documents where doc_id % 6 = 0")
def read_records(spark, sf_dir):
    d = F.col("doc_id")
    answer = F.when(d % 4 == 0, ', "对应答案": null').when(d % 4 == 1, "").otherwise(F.concat(F.lit(', "对应答案": "'), F.col("lang"), F.lit('"')))
    line = F.concat(F.lit('{"题目编号": "1"'), answer, F.when(d % 5 == 0, ', "sub_qa": "no list"').otherwise(""), F.lit("}"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 6 == 0, "{broken").otherwise(line).alias("value"))
    return records_from_json(lines).select("doc_id", "answer", "has_sub_qa", "corrupt")

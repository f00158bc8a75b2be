"""Registered queries of the operators for training text: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from .storing import small_batches_for

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where SQL can express it."""
    def keep(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            small_batches_for(spark)
            return build(tune(spark), folder)
        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build
    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op10_substring_dedup", r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
p as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i from t),
g as (select doc_id, i, word, case when count(*) over d = 20 then string_agg(word, ' ') over d end s
 from p window d as (partition by doc_id order by i rows between current row and 19 following)),
f as (select s, min({'d': doc_id, 'i': i}) m from g where s is not null group by s),
r as (select g.*, coalesce(f.m.d <> doc_id or f.m.i <> i, false) later from g left join f on g.s = f.s),
c as (select *, bool_or(later) over (partition by doc_id order by i rows between 19 preceding and current row) gone from r)
select t.doc_id, cast(any_value(len(w)) as bigint) n_words, count(*) filter (gone) n_removed,
 sha256(coalesce(string_agg(word, ' ' order by i) filter (not gone), '')) kept_sha256
from t left join c on t.doc_id = c.doc_id group by t.doc_id""")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words that remain after repeats of 20 words are removed."""
    from .repeats import remove_repeats
    return (remove_repeats(table(spark, folder, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))


@query("op8_simhash")
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document, links at 4 bits."""
    from .simhash import hex_digits, near_duplicates
    return (near_duplicates(table(spark, folder, "documents"))
            .select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id"))


@query("op7_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and how much of it 512 tokens hold."""
    import public_tokenizers

    from .bpe_counts import token_counts as counts
    return counts(table(spark, folder, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), limit=512)


@query("op6_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again: its tokens, a hash of the ids, and what came back."""
    import public_tokenizers

    from .unigram import decode, encode
    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, folder, "documents").select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    coded = encode(docs, model, keep=["text_sha256"]).select("*", F.xxhash64("ids").alias("ids_hash"))
    back = F.sha2(F.col("decoded").cast("binary"), 256)
    return decode(coded, model).select("doc_id", "n_tokens", "n_byte_tokens", "ids_hash", back.alias("decoded_sha256"),
                                       F.coalesce(back == F.col("text_sha256"), F.lit(False)).alias("round_trip"))


@query("op9_topk", """
with v as (select distinct vec_id, [floor(256 * cast(x as double)) for x in embedding] e from embeddings
 where vec_id is not null and embedding is not null
 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score
 from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 5""")
def topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 best of every row for the query rows."""
    from .topk import top_k
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and robust distance of every document."""
    from .outliers import quality_rules as rules
    return (rules(table(spark, folder, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    F.round("distance", 3).alias("distance"), "kept"))


@query("op4_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    from .rule_ensemble import classify
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_backoff_scores", r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
p as (select doc_id, unnest(w) w3, unnest(range(1, len(w) + 1)) i from t),
g as (select doc_id, i, w3, lag(w3) over d w2, lag(w3, 2) over d w1 from p window d as (partition by doc_id order by i)),
c1 as (select w3, count(*) n from g group by all),
c2 as (select w2, w3, count(*) n from g where w2 is not null group by all),
c3 as (select w1, w2, w3, count(*) n from g where w1 is not null group by all),
s as (select g.doc_id, case
  when c3.n >= 2 then ln(c3.n / b.n)
  when c2.n >= 2 then ln(c2.n / u.n) + case when g.w1 is not null then ln(0.4) else 0 end
  else ln(c1.n / (select count(*) from p)) + case when g.w1 is not null then 2 * ln(0.4) when g.w2 is not null then ln(0.4) else 0 end
  end x from g join c1 on g.w3 = c1.w3
 left join c2 on g.w2 = c2.w2 and g.w3 = c2.w3 left join c3 on g.w1 = c3.w1 and g.w2 = c3.w2 and g.w3 = c3.w3
 left join c1 u on g.w2 = u.w3 left join c2 b on g.w1 = b.w2 and g.w2 = b.w3)
select t.doc_id, cast(len(w) as bigint) n_words, round(coalesce(x, 0.0), 3) log_score
from t left join (select doc_id, sum(x) x from s group by all) r on t.doc_id = r.doc_id""")
def backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Trigram stupid-backoff score of every document under the counts of all documents."""
    from .backoff import backoff_scores as scores
    return scores(table(spark, folder, "documents")).withColumn("log_score", F.round("log_score", 3))


def _digits(source: str) -> str:
    return f"try_cast(nullif(regexp_extract({source}, '([0-9]{{1,9}})$', 1), '') as int)"


DOMAIN = f"case coalesce({_digits('source')} % 4, 9) when 0 then 'web' when 1 then 'books' when 2 then 'forums' when 3 then 'reference' else 'other' end"
DOMAIN_WEIGHT = DOMAIN.replace("'web'", "4").replace("'books'", "3").replace("'forums'", "1").replace("'reference'", "2").replace("'other'", "1")
LANG_WEIGHT = "case when lang = 'en' then 4 when lang in ('de', 'es', 'fr') then 2 else 1 end"


def target_levels() -> list:
    """Domain (by the number of the source), language and source, with their weights."""
    from .mixing import Level
    return [Level("domain", F.expr(DOMAIN), F.expr(DOMAIN_WEIGHT)), Level("lang", F.col("lang"), F.expr(LANG_WEIGHT)),
            Level("source", F.col("source"), F.lit(1))]


def _shared(name: str, nodes: str, parents: str, key: str) -> str:
    """SQL of one level of the budget tree, from ``nodes`` (parents, key, weight, capacity, budget)."""
    order = f"partition by {parents} order by capacity / weight, {key}"
    return f"""{name}_a as (select *, cast(coalesce(sum(capacity) over (u rows between unbounded preceding and 1 preceding), 0) as hugeint) c,
 cast(sum(weight) over (u rows between current row and unbounded following) as hugeint) w from {nodes} window u as ({order})),
{name}_b as (select *, capacity * w <= (budget - c) * weight as satisfied from {name}_a),
{name} as (select *, cast(case when satisfied then capacity else (budget - min(c) filter (where not satisfied) over (partition by {parents})) * weight
 // max(w) filter (where not satisfied) over (partition by {parents}) end as bigint) quota from {name}_b)"""


MIXING_SQL = rf"""with t as (select doc_id, coalesce('=' || ({DOMAIN}), 'null') "domain", coalesce('=' || lang, 'null') lang, coalesce('=' || source, 'null') source,
 {DOMAIN_WEIGHT} wd, {LANG_WEIGHT} wl, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) n_tokens from documents),
leaf as (select "domain", lang, source, max(wd) wd, max(wl) wl, 1 ws, cast(sum(n_tokens) as hugeint) tokens, 4 * cast(sum(n_tokens) as hugeint) capacity from t group by 1, 2, 3 having sum(n_tokens) > 0),
n1 as (select "domain", max(wd) weight, sum(capacity) capacity, (select least(sum(capacity), sum(tokens) * 5 // 4) from leaf) budget, 1 one from leaf group by 1),
{_shared("s1", "n1", "one", '"domain"')},
n2 as (select "domain", lang, max(wl) weight, sum(leaf.capacity) capacity, any_value(quota) budget from leaf join (select "domain", quota from s1) using ("domain") group by 1, 2),
{_shared("s2", "n2", '"domain"', "lang")},
n3 as (select "domain", lang, source, ws weight, leaf.capacity, quota budget, tokens from leaf join (select "domain", lang, quota from s2) using ("domain", lang)),
{_shared("s3", "n3", '"domain", lang', "source")},
e as (select t.*, quota // tokens "full", quota % tokens rest, md5(concat_ws('|', '1', cast(quota // tokens as varchar), coalesce(cast(doc_id as varchar), 'null'))) h
 from t join (select "domain", lang, source, quota, tokens from s3 where quota > 0) using ("domain", lang, source)),
r as (select *, sum(n_tokens) over (partition by "domain", lang, source order by h, doc_id, n_tokens rows unbounded preceding) upto from e),
x as (select *, unnest(range(cast("full" + case when upto <= rest then 1 else 0 end as bigint))) epoch from r)
select doc_id, "domain", lang, source, cast(n_tokens as bigint) n_tokens, cast(epoch as int) epoch from x"""


@query("op2_mixing", MIXING_SQL)
def mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and epochs that spend five quarters of all tokens by target weights, four epochs at most."""
    from .mixing import mix
    return mix(table(spark, folder, "documents"), target_levels(), budget_share=(5, 4), max_epochs=4, seed=1)


@query("op3_chat_snapshots", r"""
with t as (select distinct conv_id, turn, role, text,
 md5(concat(coalesce('r' || role, 'n'), chr(31), coalesce('t' || text, 'n'))) d from conversations where conv_id is not null),
o as (select *, row_number() over w pos, string_agg(d, '') over (w rows unbounded preceding) p, count(*) over (partition by conv_id) n
 from t window w as (partition by conv_id order by turn nulls first, d)),
k as (select min(conv_id) conv_id, count(*) n_copies from o where pos = n and p not in (select p from o where pos < n) group by p)
select o.conv_id, any_value(n) n_turns, any_value(n_copies) n_copies,
 string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10), '' order by pos) || '<|end|>' rendered
from o join k on o.conv_id = k.conv_id group by o.conv_id""")
def chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal conversations as chat text."""
    from .snapshots import render_maximal
    return render_maximal(table(spark, folder, "conversations"))


def _crc32(value: str) -> str:
    """SQL for the CRC-32 of a number's decimal digits, bit by bit with the reversed polynomial 0xEDB88320."""
    steps = f"flatten([[cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(cast({value} as varchar), '')])"
    return (f"xor(list_reduce({steps}, lambda s, b: case when b >= 0 then xor(s, b) else xor(s >> 1, 3988292384 * (s & 1)) end, "
            "4294967295::bigint), 4294967295)")


PERIODIC_SQL = rf"""
with t as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, {_crc32("doc_id")} h from documents),
m as (select *, len(w) n, (h // 10) % greatest(len(w), 1) a, 3 + (h // 10) % 8 e from t),
u as (select r, doc_id, n, case when h % 10 = 0 and n > 0 then [w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // e) end] for i in range(n)] else w end w from m),
p as (select r, unnest(w) word, unnest(range(n)) i from u),
g as (select *, lead(word, 1) over d w1, lead(word, 2) over d w2, lead(word, 3) over d w3, lead(word, 4) over d w4 from p window d as (partition by r order by i)),
k as (select r, i, hash(word, w1, w2, w3, w4) f, word, w1, w2, w3, w4 from g where w4 is not null),
q as (select a.r, a.i, b.i - a.i d from k a join k b on a.r = b.r and a.f = b.f and b.i > a.i and a.word = b.word and a.w1 = b.w1 and a.w2 = b.w2
  and a.w3 = b.w3 and a.w4 = b.w4),
s as (select r, d, i, i - row_number() over (partition by r, d order by i) island from q),
l as (select r, min(i) "start", d + count(*) + 4 as "length", d from s group by r, d, island having count(*) + 4 >= greatest(6 - d, 3 * d)),
o as (select r, "start", "length", min(d) period from l group by all),
x as (select p.r, p.i, p.word, exists (select 1 from o where o.r = p.r and p.i >= o."start" + o.period and p.i < o."start" + o."length") gone
 from p where r in (select r from o)),
c as (select r, string_agg(word, ' ' order by i) filter (not gone) kept from x group by r),
b as (select r, count(*) n_runs, arg_min({{'s': "start", 'l': "length", 'p': period}}, {{'l': -"length", 's': "start", 'p': period}}) best,
 string_agg("start" || ',' || "length" || ',' || period || chr(10), '' order by "start", period) listed from o group by r)
select doc_id, coalesce(n_runs, 0) n_runs, cast(best.s as bigint) as "start", cast(best.l as bigint) as "length", cast(best.p as bigint) period,
 cast(1000 * best.l // best.p as bigint) exponent_milli, sha256(coalesce(listed, '')) runs_sha256,
 sha256(case when n_runs is null then array_to_string(w, ' ') else coalesce(kept, '') end) collapsed_sha256
from u left join b on u.r = b.r left join c on u.r = c.r"""


def with_periods(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``text``) where a tenth of the documents, by the CRC-32 of the id, goes on periodically from some word on."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    n = F.size("w")
    a = F.expr("cast((h div 10) % greatest(size(w), 1) as int)")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.expr("(h div 10) % 8"))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), times)), F.lit(1), n - a)
    return rows.select("doc_id", F.when(F.col("w").isNotNull() & (n > 0), F.array_join(F.concat(F.slice("w", F.lit(1), a), again), " "))
                       .otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", PERIODIC_SQL)
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, the longest one, and hashes of all runs and of the text without their repetitions."""
    from .periodic import periodic_runs as runs
    found = runs(with_periods(table(spark, folder, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
                        F.col("best.p").alias("period"), F.expr("1000 * -best.l div best.p").alias("exponent_milli"),
                        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between two tokenisers' tokens of every document, with the corpus-wide counts of linked ids."""
    import public_tokenizers

    from .alignment import align
    digest = lambda written: F.when(written == "", F.lit("")).otherwise(F.sha2(written.cast("binary"), 256))
    return align(table(spark, folder, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")),
                 str(public_tokenizers.path("piece_bpe_32k.model")), groups=digest).withColumnRenamed("groups", "groups_sha256")


@query("op12_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links of every vector at a cosine of 0.95, and the smallest id that they reach."""
    from .hnsw import near_vectors
    return near_vectors(table(spark, folder, "embeddings"), least=0.95)

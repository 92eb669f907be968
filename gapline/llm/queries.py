"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import chat, decontam, exactdup, fim, htmltext, language, lmscore, media, neardup, packing, periodic, substrings, urlfilter
from gapline.llm.shared import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what is labelled good and not toxic; ``keep`` is on the target's side of the point between both sides' means."""
    target = table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0")
    out = materialise(lmscore.score(table(spark, sf_dir, "documents"), target), "scores")
    return out.withColumn("keep", F.coalesce(F.col("score") <= lmscore.divide(out, target), F.lit(False)))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.main_text(pages, htmltext.learn(pages))


def op3_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(told).alias("text"),
    )
    tree = chat.as_tree(turns.unionByName(extra))
    out = chat.format_paths(tree, chat.reply_paths(tree), branches=1)
    out = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("mask"))})
    told_all = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told_all, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.with_metadata(media.store(table(spark, sf_dir, "documents"))))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2(F.coalesce("kept", F.coalesce("text", F.lit("")).cast("binary")), 256).alias("kept_sha256"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.fit(docs, language.not_held_out()))
    return out.select("doc_id", (~language.not_held_out()).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch")


def op11_exactdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.find(table(spark, sf_dir, "documents"))


def with_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; of the documents whose h = crc32(doc_id) is a multiple of 10, the words from the a-th on repeat the p words from there."""
    g = F.floor(F.col("h") / 10)
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.where("h % 10 = 0").withColumn("w", words).withColumn("n", F.size("w")).where("n > 0")
    some = some.withColumn("a", (g % F.col("n")).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    some = some.select("doc_id", F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ").alias("text"))
    rest = docs.where(F.coalesce(F.col("h") % 10 != 0, F.lit(True)) | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return rest.select("doc_id", "text").unionByName(some)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse_runs(with_runs(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    out = out.withColumns({"best": periodic.strongest(F.col("runs")), "lines": F.array_join(line, "\n")})
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_lmscore,
        op2_html,
        op3_url,
        op4_neardup,
        op5_decontaminate,
        op6_chat,
        op7_media,
        op8_substrings,
        op9_language,
        op10_packing,
        op11_exactdup,
        op12_periodic,
        op13_fim,
    ]
    return {f.__name__: f for f in found}


HOST = "translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
_TWO = "regexp_extract(host, '([^.:]+[.][^.:]+)(:[0-9]*)?$', 1)"
_THREE = "regexp_extract(host, '([^.:]+[.][^.:]+[.][^.:]+)(:[0-9]*)?$', 1)"
_SECOND = f"regexp_matches({_TWO}, '^({'|'.join(urlfilter.SECOND)})[.][a-z]{{2}}$')"
_M = """select case when t - t2::double / t = 0 or t is null then 10.0 else least(1000.0, greatest(1.0, 1 / greatest((v - k) / (t - t2::double / t), 1e-3) - 1)) end
from (select sum(n * (s::double / n - p) * (s::double / n - p) / (p * (1 - p))) v, count(*) k, sum(n) t, sum(n * n) t2 from {} where n > 0 and p > 0 and p < 1)"""
_RULED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_CASE = "case " + " ".join(
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{{{k}}}'" for k, (_, h, p) in enumerate(_RULED)
) + " end"



def _density(t: str) -> str:
    return f"(-a * (greatest(-({t}), 0.0) + ln(1 + exp(-abs({t})))) - b * (greatest({t}, 0.0) + ln(1 + exp(-abs({t})))))"


def _integral(x: str, y: str) -> str:
    step = f"(({y} - {x}) / {urlfilter.NODES}.0)"
    return f"{step} * list_sum(list_transform(range({urlfilter.NODES}), lambda k: exp({_density(f'({x} + (k + 0.5) * {step})')} - {_density('mid')})))"


OP3 = f"""
with own as (select page_id, {HOST} as host, {PATH} as path from pages),
one as (select doc_id, case when min(quality) = 1 and max(coalesce(toxic, 0)) = 0 then 1 else 0 end good from labels where doc_id is not null and quality is not null group by doc_id),
base as (select host, {_TWO} as two, {_THREE} as three, count(good) n, coalesce(sum(good), 0) s from own left join one on page_id = doc_id where host <> '' group by host),
named as (select host, n, s, case when {_SECOND} then two else regexp_extract(host, '([^.:]*)(:[0-9]*)?$', 1) end suffix,
  case when {_SECOND} and three <> '' then three when two = '' then host else two end as domain from base),
suffixes as (select suffix, sum(n) n, sum(s) s, (select (sum(s) + 1.0) / (sum(n) + 2.0) from named) p from named group by suffix),
suffix_p as (select suffix, (s + ({_M.format("suffixes")}) * p) / (n + ({_M.format("suffixes")})) p from suffixes),
domains as (select domain, suffix, sum(named.n) n, sum(named.s) s, any_value(p) p from named join suffix_p using (suffix) group by domain, suffix),
domain_p as (select domain, suffix, (s + ({_M.format("domains")}) * p) / (n + ({_M.format("domains")})) p from domains),
hosts as (select host, n, s, p from named join domain_p using (domain, suffix)),
post as (select host, s + m * p a, n - s + m * (1 - p) b from (select *, ({_M.format("hosts")}) m from hosts)),
limits as (select host as known, a, b, ln(a / b) mid, ln(a / b) - 8.0 * sqrt(1.0 / a + 1.0 / b) - 12.0 / a lo, ln(a / b) + 8.0 * sqrt(1.0 / a + 1.0 / b) + 12.0 / b hi from post),
bounds as (select known, {_integral("cut", "hi")} / ({_integral("cut", "hi")} + {_integral("lo", "cut")}) mass from (select *, greatest(lo, least(hi, 0.0::double)) cut from limits))
select page_id, host, path, {_CASE.format(*[h + p for _, h, p in _RULED])} as rule,
  coalesce({_CASE.format(*[v for v, _, _ in _RULED])}, case when mass >= 0.95 then 'allow' else 'block' end) as verdict
from own left join bounds on host = known
"""


def _escaped(x: str) -> str:
    x = f"replace({x}, chr(92), chr(92) || 'b')"
    for c in chat.CONTROL:
        x = f"replace({x}, '{c}', chr(92) || '{chat.FIRST[c[0]][1:] + c[1:]}')"
    return x


OP6 = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_escaped("role")}) + length({_escaped("text")})) as bigint) as formatted_chars
from t group by conv_id
"""


AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
with recursive d as (select doc_id, regexp_extract_all({AZ}, '[^\\x20\\x09-\\x0D]+') w from documents),
sh as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[k : k + 4], ' ') end g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) k from d where len(w) > 0)),
n as (select doc_id, count(*) n from sh group by doc_id),
common as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select x, y from common join n p on x = p.doc_id join n q on y = q.doc_id where 100 * c >= 85 * (p.n + q.n - c)),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
least_ as (select x, min(y) m from reach group by x)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id, m is null or d.doc_id <= m kept
from d left join n on d.doc_id = n.doc_id left join least_ on d.doc_id = x
"""

_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
OP5 = f"""
with d as (select doc_id, row_number() over () rid, regexp_extract_all({AZ}, {_WORD}) w from documents),
i as (select item_id::varchar item, regexp_extract_all({AZ}, {_WORD}) w from benchmark),
wins as (select distinct item, s, array_to_string(w[k : k + s - 1], ' ') win
  from (select item, w, least(13, len(w)) s, unnest(range(1, len(w) - least(13, len(w)) + 2)) k from i where len(w) > 0)),
dw as (select rid, s, k, array_to_string(w[k : k + s - 1], ' ') win from (select rid, w, s, unnest(range(1, len(w) - s + 2)) k from d, (select distinct s from wins) where len(w) >= s)),
hits as (select rid, k, s, item from dw join wins using (s, win)),
hit as (select rid, count(distinct p) n from (select rid, unnest(range(k, k + s)) p from (select distinct rid, k, s from hits)) group by rid),
found as (select rid, count(distinct item) n, string_agg(distinct item, ',' order by item) ids from hits group by rid)
select doc_id, len(w) n_words, coalesce(hit.n, 0) n_hit, coalesce(found.n, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) contaminated from d left join hit using (rid) left join found using (rid)
"""

OP8 = """
with d as (select doc_id, row_number() over () rid, hex(encode(coalesce(text, ''))) h from documents),
parts as (select rid, len(h) // 2 n, 256 * c base, substring(h, 512 * c + 1, 910) part from (select rid, h, unnest(range(0, (len(h) // 2 - 200) // 256 + 1)) c from d where len(h) >= 400)),
w as (select rid, base + k k, md5(substring(part, 2 * k + 1, 400)) m from (select rid, base, part, unnest(range(0, least(256, n - 199 - base))) k from parts)),
often as (select m from w group by m having count(*) > 1),
starts as (select rid, k, k > lag(k, 1, -1000) over (partition by rid order by k) + 200 fresh from w join often using (m)),
spans as (select rid, min(k) a, max(k) + 200 z from (select rid, k, sum(fresh::int) over (partition by rid order by k) run from starts) group by rid, run),
cut as (select rid, a, z, lag(z, 1, 0) over (partition by rid order by a) p from spans),
kept as (select rid, sum(z - a)::bigint gone, count(*) runs, max(z) last, string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' order by a) t from cut join d using (rid) group by rid)
select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(gone, 0) n_removed, coalesce(runs, 0) n_spans,
  sha256(unhex(case when last is null then h else t || substring(h, 2 * last + 1) end)) kept_sha256 from d left join kept using (rid)
"""


OP11 = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
  doc_id = min(doc_id) over (partition by t) kept, sha256(t) text_sha256 from t
"""

#: stretches of words that agree with those q later, by a join on words within a third of the text; of those with the same ends the least q is the period
_BITS = "list_transform(range(8 * length(s)), lambda k: (ascii(s[k // 8 + 1]) >> (k % 8)) & 1)"
_CRC = f"xor(list_reduce([4294967295] || {_BITS}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"

OP12 = rf"""
with src as (select doc_id, doc_id::varchar s, row_number() over () rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
h as (select doc_id, rid, w, coalesce({_CRC}, 1) crc from src),
made as (select doc_id, rid, w, len(w) n, crc % 10 = 0 and len(w) > 0 own, case when len(w) > 0 then (crc // 10) % len(w) end a, (crc // 10) % 8 e from h),
x as (select doc_id, rid, n, case when own then list_concat(w[1 : a], list_transform(range(a, n), lambda i: w[1 + a + (i - a) % (1 + (n - a) // (3 + e))])) else w end w from made),
p as (select rid, n, unnest(range(n)) i, unnest(w) t from x where n >= 24),
eq as (select l.rid, r.i - l.i q, l.i from p l join p r on l.rid = r.rid and l.t = r.t and r.i > l.i and 3 * (r.i - l.i) <= l.n),
st as (select rid, q, min(i) a, count(*) + q length from (select rid, q, i, i - row_number() over (partition by rid, q order by i) g from eq) group by rid, q, g),
runs as (select rid, a, length, min(q) q from st where length >= greatest(24, 3 * q) group by rid, a, length),
best as (select rid, a, length, q, row_number() over (partition by rid order by length::hugeint * 1000000000000 // q desc, a, q) k from runs),
listed as (select rid, count(*) n_runs, string_agg(a || ',' || length || ',' || q || chr(10), '' order by a, q) s from runs group by rid),
gone as (select distinct rid, unnest(range(a + q, a + length)) i from runs),
kept as (select p.rid, string_agg(t, ' ' order by i) c from p left join gone using (rid, i) where gone.i is null group by p.rid)
select doc_id, coalesce(n_runs, 0) n_runs, b.a start, b.length, b.q period, 1000 * b.length // b.q exponent_milli,
  sha256(coalesce(s, '')) runs_sha256, sha256(coalesce(c, array_to_string(w, ' '))) collapsed_sha256
from x left join listed using (rid) left join best b on b.rid = x.rid and k = 1 left join kept on kept.rid = x.rid
"""

OP13 = """
with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) h from documents),
e as (select *, string_split(t, chr(10)) parts, length(t) - length(replace(t, chr(10), '')) + (t <> '' and not ends_with(t, chr(10)))::int n,
  ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) i, greatest(h1 % (n + 1), h2 % (n + 1)) j,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form from e),
k as (select *, case when i = n then length(t) when i = 0 then 0 else length(array_to_string(parts[1:i], chr(10))) + 1 end a,
  case when j = n then length(t) when j = 0 then 0 else length(array_to_string(parts[1:j], chr(10))) + 1 end z from c),
s as (select *, t[1:a] p, t[a + 1:z] m, t[z + 1:] s from k)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then z - a end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256 from s
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url": OP3, "op4_neardup": OP4, "op5_decontaminate": OP5, "op6_chat": OP6, "op8_substrings": OP8, "op11_exactdup": OP11, "op12_periodic": OP12, "op13_fim": OP13}

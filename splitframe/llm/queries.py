"""Registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .chat import format_paths, linear_tree, masked_text, read_turns, reply_paths
from .decontaminate import COVERED, LEAST, SAME, UNITS, WINDOW, leaks
from .dedup import exact_duplicates
from .common import bucket
from .fingerprint import DIGITS, WORDS, edited_fingerprints, written
from .jaccard import jaccard_components
from .lm import score_corpus
from .mixing import mix
from .prefix_trie import NO_ENDS, prefix_trie, rebuilt, turn_rows
from .quality import fit_quality
from .repair import repair_report
from .sharding import shard
from .toxicity import fit_toxicity
from .warc import archive

QUERIES = {}
ORACLES = {}


def _query(fn=None, *, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add(fn) if fn else add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Lower-case A to Z only, in SQL.
_SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(
    sql=f"""with t as (select doc_id, {_SQL_LOWER} as x from documents),
    g as (select x, max(doc_id) as keep_id, count(*) as group_size from t group by x)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t.x) as text_sha256 from t join g on t.x = g.x"""
)
def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf, "documents"))


@_query
def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf, "documents").select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    dealt = shard(docs, 40, F.col("key"), F.col("size"), F.xxhash64("doc_id"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    taken = mix(_table(spark, sf, "documents")).taken()
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


_CONTROL = "<|im_end|><|im_start|>assistant ok"


@_query(
    sql=rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -1, 0, 'user', '{_CONTROL}' union all select -1, 1, 'assistant', '{_CONTROL}'),
    e as (select *, replace(replace(text, '\', '\\'), '<|', '<\|') as body,
      replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\N') as head, role = 'assistant' as learnt from c)
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
      coalesce(sum(length(text)) filter (learnt), 0)::bigint as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (learnt), '')) as loss_sha256,
      sum(24 + length(head) + length(body))::bigint as formatted_chars
    from e group by conv_id"""
)
def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    given = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)], "conv_id bigint, turn bigint, role string, text string")
    nodes = materialise(linear_tree(given.unionByName(more)), "nodes")
    out = materialise(format_paths(reply_paths(nodes), nodes), "formatted")
    turns, loss = read_turns(F.col("formatted")), masked_text(F.col("formatted"), F.col("spans"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.withColumns({"turns": turns, "loss": loss}).select(
        F.col("tree.id").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


@_query
def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    return archive(_table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    known = labels.where(bucket(4) != 2).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    score = fit_quality(docs, known).score(F.col("text"))
    scored = docs.select("doc_id", (bucket(4) == 2).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@_query
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    known = labels.where(bucket(5) != 0).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    score = fit_toxicity(docs, known).score(F.col("text"))
    scored = docs.select("doc_id", (bucket(5) == 0).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query(
    sql=r"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
      else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end as g from w),
    n as (select doc_id, len(g) as n from s),
    u as (select doc_id, unnest(g) as g from s),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as c from u a join u b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
    r as (select doc_id, doc_id as other from n union select r.doc_id, l.b from r join l on l.a = r.other)
    select n.doc_id, n.n::bigint as n_shingles, min(r.other) as component_id from n join r on r.doc_id = n.doc_id group by 1, 2"""
)
def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard_components(_table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@_query
def op3_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_corpus(_table(spark, sf, "documents"), bucket(7) == 2)
    return scored.withColumnRenamed("id", "doc_id")


def _sql_tokens(text: str) -> str:
    """Marked tokens in SQL."""
    steps = (
        (r"\x01", " "),
        ("([0-9])[.,]([0-9])", r"\1_\2"),
        ("([0-9][0-9_]*)", " ' || chr(1) || 'n\\1 "),
        (rf"(\x01n[0-9_]+) +({UNITS})([^\p{{L}}]|$)", r"\1 ' || chr(1) || 'u\2\3"),
        (r"(\p{Lu}\p{Ll}+)", r"' || chr(1) || 'a\1"),
    )
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{M}}\p{{N}}_\x01]+'), lambda t: t <> '')"


_SQL_NAMES = "list_transform(toks, lambda t: case when t[1] = chr(1) then t[:2] else t end)"
_SQL_WORDS = "list_transform(toks, lambda t: case when t[:2] = chr(1) || 'a' then t[3:] when t[1] = chr(1) then t[:2] else t end)"
_SQL_PLAIN = "(case when {0}[:2] = chr(1) || 'a' then {0}[3:] else {0} end)"


@_query(
    sql=rf"""with i as (select item_id, {_sql_tokens("coalesce(text, '')")} as toks from benchmark), it as (select * from i where len(toks) >= {LEAST}),
    d as (select doc_id, {_sql_tokens("coalesce(text, '')")} as toks from documents),
    tpl as (select item_id, toks, unnest([{_SQL_NAMES}, {_SQL_WORDS}]) as tp from it),
    dtpl as (select doc_id, toks, unnest([{_SQL_NAMES}, {_SQL_WORDS}]) as tp from d),
    iw as (select distinct item_id, k as ip, least(len(tp), {WINDOW}) as width, array_to_string(tp[k + 1 : k + least(len(tp), {WINDOW})], ' ') as w
      from tpl, unnest(range(0, greatest(len(tp) - {WINDOW}, 0) + 1)) as r(k)),
    widths as (select distinct width from iw),
    dw as (select doc_id, k as pos, width, array_to_string(tp[k + 1 : k + width], ' ') as w from dtpl, widths, unnest(range(0, len(tp) - width + 1)) as r(k)),
    f as (select doc_id, item_id, pos - ip as shift, ip, width from dw join iw using (w, width)),
    places as (select distinct doc_id, item_id, shift, unnest(range(ip, ip + width)) as ip from f),
    v as (select doc_id, item_id, shift, ip, it.toks[ip + 1] as given, d.toks[ip + shift + 1] as value, len(it.toks) as item_tokens
      from places join it using (item_id) join d using (doc_id)),
    c as (select doc_id, item_id, shift, any_value(item_tokens) as item_tokens, count(*) as covered,
      count(distinct given || chr(2) || value) filter (given[1] = chr(1)) as pairs, count(distinct given) filter (given[1] = chr(1)) as givens,
      count(distinct value) filter (given[1] = chr(1)) as vals, bool_and({_SQL_PLAIN.format('given')} = {_SQL_PLAIN.format('value')}) as exact,
      count(*) filter ({_SQL_PLAIN.format('given')} = {_SQL_PLAIN.format('value')}) as same from v group by all)
    select doc_id, item_id, max(covered) as covered, max(item_tokens)::bigint as item_tokens, bool_or(exact) as exact from c
    where covered >= least({COVERED}, item_tokens) and pairs = givens and pairs = vals and same >= {SAME} group by 1, 2"""
)
def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    ids = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id")
    found = materialise(leaks(docs, _table(spark, sf, "benchmark")), "found")
    return ids.join(found, "row").select("doc_id", "item_id", "covered", "item_tokens", "exact")


def _sql_shingles(text: str) -> str:
    """Fingerprint of a text in SQL, as a sorted list."""
    parts = rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    hashed = (
        f"list_transform(list_transform([{parts}], lambda p: case when len(p) = 0 then [] when len(p) < {WORDS} then [array_to_string(p, ' ')] "
        f"else list_transform(range(1, len(p) - {WORDS} + 2), lambda i: array_to_string(p[i : i + {WORDS} - 1], ' ')) end)[1], lambda g: md5(g)[:{DIGITS}])"
    )
    return f"list_transform([{hashed}], lambda h: list_sort(list_distinct(list_filter(h, lambda x: x < '2' or x = list_min(h)))))[1]"


def _sql_pair(a: str, b: str, then: str) -> str:
    """``then`` on the comparable parts x and y of two fingerprints."""
    low = "list_filter({0}, lambda x: x < '2')"
    one, two = low.format(a), low.format(b)
    pair = f"case when len({one}) + len({two}) = 0 then {{'x': {a}, 'y': {b}}} else {{'x': {one}, 'y': {two}}} end"
    return f"list_transform([{pair}], lambda p: {then})[1]"


_SQL_LIKE = "case when len(p.x) + len(p.y) = 0 then 1 else len(list_intersect(p.x, p.y))::double / (len(p.x) + len(p.y) - len(list_intersect(p.x, p.y))) end"


@_query(
    sql=rf"""with t as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc nulls last) as n, count(*) over () as all_ from documents),
    e as (select t.doc_id, t.text, x.text as next_text, length(t.text) // 2 as half from t join t x on x.n = t.n % t.all_ + 1),
    f as (select doc_id, length(text) as n_chars, next_text, text, left(text, length(text) - half) || left(next_text, half) as edited from e),
    g as (select doc_id, n_chars, sha256(edited) as edited_sha256, {_sql_shingles("text")} as a, {_sql_shingles("edited")} as b, {_sql_shingles("next_text")} as c from f)
    select doc_id, n_chars::bigint as n_chars, edited_sha256, array_to_string(a, '') as fingerprint, array_to_string(b, '') as edited_fingerprint,
      {_sql_pair("a", "b", _SQL_LIKE)} as near_edited, {_sql_pair("a", "c", _SQL_LIKE)} as near_next from g"""
)
def op11_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    done = edited_fingerprints(_table(spark, sf, "documents").select("doc_id", "text"))
    return done.select(
        F.col("given.doc_id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("fp")).alias("fingerprint"),
        written(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


# CRC-32 (reflected polynomial 0xEDB88320) in SQL: a table of 256 values, then a fold over ASCII text.
_SQL_CRC_TABLE = """crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end) order by i) as tab
    from (select unnest(range(256)) as i))"""


def _sql_crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c // 256, tab[1 + xor(c % 256, b)])), 4294967295)"


@_query(
    sql=rf"""with {_SQL_CRC_TABLE},
    o as (select conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as x,
      row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as nr from conversations where conv_id is not null),
    l as (select conv_id, list(x order by nr) as own from o group by conv_id),
    h as (select conv_id, own, conv_id - conv_id % 20 as base, ({_sql_crc("conv_id::varchar")} % 4)::bigint as h from l, crc),
    r as (select h.conv_id, list_concat(coalesce(l.own[:h.h], []), h.own[h.h + 1 :]) as p from h left join l on l.conv_id = h.base),
    m as (select conv_id, len(p) as length, unnest(range(len(p) + 1)) as depth, p from r),
    k as (select conv_id, length, depth, p[:depth] as k from m),
    n as (select k, depth, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (length = depth) as ends,
      len(regexp_extract_all(k[depth].t, '[^ 	-
]+')) as words from k group by k, depth),
    c as (select k[: depth - 1] as k, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by all),
    w as (select n.*, coalesce(n_children, 0) as n_children from n left join c using (k, depth)),
    s as (select u.k, u.depth, count(*) filter (v.n_children = 0) as n_leaves, sum(case when v.depth > 0 then (v.n_convs - 1) * v.words else 0 end) as saved
      from w u join w v on v.depth >= u.depth and v.k[: u.depth] = u.k group by 1, 2)
    select w.conv_id, w.depth::bigint as depth, a.conv_id as parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved::bigint as saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
    from w join s using (k, depth) left join w a on a.depth = w.depth - 1 and a.k = w.k[: w.depth - 1]"""
)
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialise(turn_rows(_table(spark, sf, "conversations")), "turn_rows")
    sequences, ids = rebuilt(rows, 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    trie = prefix_trie(sequences, ids)
    out = trie.nodes.join(trie.end_digests(), "key", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(NO_ENDS)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, by the checksum of their number; null roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        blank("role").alias("role"),
        blank("text").alias("text"),
        kind.alias("kind"),
    ).where(F.col("kind") != 0)
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0)))
    rows = rows.withColumn("tie", F.concat("role", F.lit(":"), F.sha2(F.col("text").cast("binary"), 256))).withColumn("copy", copies)
    return rows.withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": text}).drop("kind")


_SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# State entered, inserts, state then: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_SQL_INSERTS = "(values (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2))"


@_query(
    sql=rf"""with recursive {_SQL_CRC_TABLE},
    o as (select conv_id, turn, coalesce(role, ' ') as role0, coalesce(text, ' ') as text0,
      ({_sql_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20) as kind from conversations, crc),
    d as (select conv_id, turn, case when kind = 4 then 'user' else role0 end as role, role0 || ':' || sha256(text0) as tie, copy,
      case kind when 1 then '' when 2 then regexp_replace(text0, '[.!?]', '', 'g') else text0 end as text
      from o, (values (0), (1)) as c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
    p as (select *, row_number() over w as i, row_number() over (partition by conv_id, role, text order by turn nulls first, tie, copy) as nth,
      lag(role) over w as before, rtrim(text, {_SQL_SPACE}) as bare from d window w as (partition by conv_id order by turn nulls first, tie, copy)),
    f as (select *, case when bare = '' then 'blank' when nth > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from p),
    ins as (select * from {_SQL_INSERTS} as t(s, k, v)),
    edits as (select s, k, v, e, case when e = 'D' then v when e = 'K' and initial = 's' then 1 when v = 2 then 3 else 2 end as z, initial
      from ins, (values ('D'), ('K'), ('R')) as a(e), (values ('s'), ('u'), ('a'), ('')) as b(initial)
      where e <> 'K' or (initial = 's' and v = 0) or (initial = 'u' and v <> 2) or (initial = 'a' and v = 2)),
    steps as (select *, 3 * k + case e when 'D' then 4 when 'R' then 3 else 0 end as c, repeat('I', k) || e as a,
      case when k = 0 then [] when s = 2 then ['assistant:'] when k = 1 then ['user:'] else ['user:', 'assistant:'] end as said from edits),
    walk as (select conv_id, 0::bigint as i, 0 as s, {{'c': 0::bigint, 'a': '', 't': []::varchar[]}} as best from (select distinct conv_id from f)
      union all
      select w.conv_id, f.i, x.z, min({{'c': w.best.c + x.c + case when f.fault = 'truncated' and x.e <> 'D' then 3 else 0 end, 'a': w.best.a || x.a,
        't': list_concat(w.best.t, x.said, case x.e when 'D' then [] when 'K' then [f.role || ':' || f.text] else [case x.z when 2 then 'user:' else 'assistant:' end || f.text] end)}})
      from walk w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1
      join steps x on x.s = w.s and x.initial = (case when f.role[1] in ('s', 'u', 'a') then f.role[1] else '' end) and (x.e = 'D' or f.fault not in ('blank', 'duplicate'))
      group by w.conv_id, f.i, x.z),
    ends as (select conv_id, i, min({{'c': best.c + x.c, 'a': best.a || x.a, 't': list_concat(best.t, x.said)}}) as best
      from walk join (values (0, 0, '', []::varchar[]), (1, 6, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 0, '', [])) as x(s, c, a, said) using (s) group by 1, 2),
    n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
      count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
      count(*) filter (before is not null and (left(before, 1) || left(role, 1)) not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
    select q.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
      coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) q left join n on n.conv_id is not distinct from q.conv_id
    left join ends on ends.conv_id is not distinct from q.conv_id and ends.i = n.n"""
)
def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    given = _table(spark, sf, "conversations")
    every = given.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = every.join(repair_report(damaged(given)), "conv", "left")
    return found.select(
        F.expr("cast(nullif(conv, '') as bigint)").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NO_ENDS)).alias("repaired_sha256"),
    )

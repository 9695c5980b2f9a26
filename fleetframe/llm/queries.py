"""The registered queries of the operators, each over its whole table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm import (
    conversations, langid, licenses, line_dedup, mixing, packing, pii, quality_rules, simhash, spelling,
    superkmer, topk, vptree,
)
from fleetframe.llm.common import table, written


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("draw")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeated three-line windows cover."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.char_length("text").cast("long").alias("n_chars"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
    )
    return line_dedup.without_repeats(docs).select(
        "doc_id", "n_lines", "n_chars", F.char_length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
with parted as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
numbered as (
    select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from parted
),
starts as (
    select doc_id, lines, unnest(range(len(lines) - 2)) as pos from parted where len(lines) >= 3
),
windows as (
    select doc_id, pos,
        lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] as body
    from starts
),
placed as (
    select doc_id, pos, row_number() over (partition by body order by doc_id, pos) as nth
    from windows where trim(body, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
),
covered as (
    select distinct doc_id, pos + step as pos
    from placed, (select unnest(range(3)) as step) where nth > 1
),
kept as (
    select n.doc_id, string_agg(n.line, chr(10) order by n.pos) as body
    from numbered n left join covered c on n.doc_id = c.doc_id and n.pos = c.pos
    where c.pos is null group by n.doc_id
)
select p.doc_id, cast(len(p.lines) as bigint) as n_lines, cast(length(p.text) as bigint) as n_chars,
    cast(length(coalesce(k.body, '')) as bigint) as kept_chars,
    sha256(coalesce(k.body, '')) as kept_sha256
from parted p left join kept k on p.doc_id = k.doc_id
"""


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and those that reliable contexts add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.span_digest(*pii.personal_data(docs)).withColumnRenamed("id", "doc_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of every document, the base rules and the learned list's verdict."""
    stats = quality_rules.statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = written(stats.select("doc_id", "stats.*"), "quality")
    rules = quality_rules.train(counts, table(spark, sf_dir, "labels"))
    first = ["doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept"]
    return quality_rules.judged(counts, rules).select(*first, *quality_rules.COUNTS[5:])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that a 13-word window of an earlier document covers."""
    return superkmer.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


OP6_SQL = r"""
with worded as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
windows as (
    select doc_id, pos, array_to_string(w[pos + 1 : pos + 13], ' ') as body
    from (select doc_id, w, unnest(range(len(w) - 12)) as pos from worded where len(w) >= 13)
),
firsts as (select body, min(doc_id) as first from windows group by body),
covered as (
    select distinct w.doc_id, w.pos + step as pos
    from windows w join firsts f on w.body = f.body and f.first < w.doc_id,
        (select unnest(range(13)) as step)
),
kept as (
    select n.doc_id, string_agg(n.word, ' ' order by n.pos) as body, count(*) as n
    from (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from worded) n
        left join covered c on n.doc_id = c.doc_id and n.pos = c.pos
    where c.pos is null group by n.doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words,
    cast(len(d.w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.body, '')) as kept_sha256
from worded d left join kept k on d.doc_id = k.doc_id
"""


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP7_SQL = """
with whole as (
    select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
    from embeddings
),
scored as (
    select q.row, q.vec_id as query_id, c.vec_id,
        cast(list_sum(list_transform(range(len(q.v)), lambda i: q.v[i + 1] * c.v[i + 1])) as bigint) as score
    from whole q join whole c on q.row <> c.row where q.vec_id % 20 = 0
),
ranked as (
    select *, cast(row_number() over (partition by row order by score desc, vec_id) as int) as rank
    from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    return langid.identified(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", simhash.hex64(F.col("bits")).alias("fingerprint"), "component_id"
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scanned(docs)
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max("matches.dice"), F.lit(0.0)).alias("best_dice"),
    )


def _op10_sql() -> str:
    rows = ",\n    ".join(
        f"({i}, '{name}', {len(licenses.template_words(text))}, [{', '.join(repr(g) for g in licenses.template_bigrams(text))}])"
        for i, (name, text) in enumerate(licenses.TEMPLATES)
    )
    return rf"""
with templates(t, name, m, grams) as (values
    {rows}
),
plain as (
    select doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') as body
    from documents
),
units as (
    select row_number() over () as unit, doc_id, kind, body from (
        select doc_id, 'line' as kind, unnest(string_split(body, chr(10))) as body from plain
        union all
        select * from (
            select doc_id, 'block' as kind, unnest(regexp_split_to_array(body, '\n *(?:\n *)+')) as body from plain
        ) where contains(body, chr(10))
    )
),
lines as (
    select unit, unnest(string_split(body, chr(10))) as line, unnest(range(len(string_split(body, chr(10))))) as l from units
),
worded as (
    select unit, l, unnest(list_filter(string_split(line, ' '), lambda w: w <> '')) as w,
        unnest(range(len(list_filter(string_split(line, ' '), lambda w: w <> '')))) as i from lines
),
placed as (
    select unit, l, w, cast(row_number() over (partition by unit order by l, i) - 1 as int) as pos from worded
),
pairs as (
    select unit, pos, l, w || ' ' || lead(w) over (partition by unit order by pos) as g,
        count(*) over (partition by unit) as width
    from placed
),
listed as (
    select unit, max(width) as width, list(g order by pos) as g, list(l order by pos) as l from pairs group by unit
),
each_gram as (select t, m, unnest(grams) as gram from templates),
hits as (
    select distinct unit, t, m, pos, width from pairs join each_gram on g = gram
),
-- A window that reaches the threshold begins at one of its pairs, or ends with words of no pair.
spans as (
    select distinct unit, t, pos - step as start, m as len
    from (select *, unnest(range(m - 1)) as step from hits where width > m)
    where pos - step >= 0 and pos - step + m <= width
    union
    select distinct unit, t, 0, width from hits
),
scored as (
    select s.unit, name, s.start, s.len,
        list_distinct(g[s.start + 1 : s.start + s.len - 1]) as own, grams, kind, l
    from spans s join listed using (unit) join templates using (t) join units using (unit)
    where s.len >= 2
),
reached as (
    select unit, name, start, len, cast(2 * len(list_intersect(own, grams)) as double) / (len(own) + len(grams)) as dice
    from scored
    where (len = len(l) or kind = 'line' or l[start + 1] <> l[start + len])
        and 2 * len(list_intersect(own, grams)) >= 0.8 * (len(own) + len(grams))
),
best as (
    select distinct unit, name, max(dice) as dice from reached c where not exists (
        select 1 from reached d where d.unit = c.unit and d.start < c.start + c.len and c.start < d.start + d.len
            and (-d.dice, d.name, d.start, d.len) < (-c.dice, c.name, c.start, c.len)
    ) group by unit, name
),
per_doc as (
    select doc_id, count(*) as n, string_agg(distinct name, ',' order by name) as names, max(dice) as dice
    from best join units using (unit) group by doc_id
)
select d.doc_id, coalesce(n, 0) as n_matches, coalesce(names, '') as licenses,
    coalesce(dice, cast(0 as double)) as best_dice
from documents d left join per_doc p on d.doc_id = p.doc_id
"""


# The checksum of a list of bytes, bit by bit; 3988292384 is the reversed polynomial.
def _crc32_sql(data: str) -> str:
    step = "lambda crc, bit: xor(crc >> 1, 3988292384 * (crc & 1))"
    byte = f"lambda r, b: list_reduce(list_prepend(xor(r, b), [cast(0 as bigint) for i in range(8)]), {step})"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {data}), {byte}), 4294967295)"


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every long and frequent word with its form, root and near words."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


_BYTES = "cast(ord(c) as bigint)"
OP11_SQL = rf"""
with runs as (
    select doc_id, run, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+'
        )) as run from documents
    ) where length(run) >= 6 group by doc_id, run
),
bytes as (
    select doc_id, run, n, flatten([
        case when ord(c) < 128 then [{_BYTES}] else [192 + ({_BYTES} >> 6), 128 + ({_BYTES} & 63)] end
        for c in string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, '')
    ]) as b from runs
),
summed as (select run, n, {_crc32_sql("b")} as h from bytes),
slipped as (
    select case when h % 199 <> 0 then run
        else substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) end as word, n
    from summed
),
words as (
    select word, cast(sum(n) as bigint) as n from slipped where length(word) >= 6
    group by word having sum(n) >= 5
),
cut as (
    select word, n, unnest([substr(word, 1, i) || substr(word, i + 2) for i in range(length(word))]) as stem from words
),
stems as (select distinct word, n, stem from cut union select word, n, word from words),
near as (
    select distinct a.word, b.word as other, b.n from stems a join stems b on a.stem = b.stem and a.word <> b.word
    where levenshtein(a.word, b.word) = 1
),
told as (select word, count(*) as n_near, min((-n, other)) as best from near group by word),
formed as (
    select w.word, w.n, coalesce(n_near, 0) as n_near,
        case when -best[1] >= 5 * w.n then best[2] end as form, case when -best[1] >= 5 * w.n then -best[1] end as form_n
    from words w left join told t on w.word = t.word
),
steps as (
    with recursive walk(word, root) as (
        select word, word from formed
        union all
        select walk.word, f.form from walk join formed f on f.word = walk.root where f.form is not null
    )
    select walk.word, walk.root from walk join formed f on f.word = walk.root where f.form is null
)
select f.word, f.form, s.root, f.n, cast(f.n_near as bigint) as n_near, cast(f.form_n as bigint) as form_n
from formed f join steps s on f.word = s.word
"""


def op12_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector."""
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = conversations.repaired(conversations.damaged(rows)).withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    empty = {n: F.coalesce(n, F.lit(0)) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return every.select("conv_id", *[c.alias(n) for n, c in empty.items()])


def _op13_sql() -> str:
    """One pass over a conversation's rows keeps, for each state, the least cost and audit and what
    they leave, as one string that sorts by cost and then audit: six digits, the audit, a tab, the
    repaired rows in a code of their numbers."""
    fields = ("z", "s", "u", "a")

    def plus(state: str, cost: str, letter: str, put: str = "''") -> str:
        return (
            f"(printf('%06d', cast({state}[1:6] as int) + {cost}) || split_part({state}[7:], chr(9), 1) || '{letter}'"
            f" || chr(9) || split_part({state}, chr(9), 2) || {put})"
        )

    def inserted(x: str) -> dict[str, str]:
        """Each state before a row, an insertion before it allowed."""
        user, helper = "'i0;'", "'j0;'"
        return {
            "z": f"{x}.z", "s": f"{x}.s",
            "u": f"least({x}.u, {plus(x + '.z', '2', 'I', user)}, {plus(x + '.s', '2', 'I', user)}, {plus(x + '.a', '2', 'I', user)})",
            "a": f"least({x}.a, {plus(x + '.u', '2', 'I', helper)})",
        }

    def passed(x: str, r: str) -> str:
        stay, extra = f"{r}.code <> '-'", f"{r}.late"
        kept, as_user, as_helper = (f"('{k}' || {r}.pos || ';')" for k in "kuh")
        into = {
            "z": [], "s": [(f"{x}.z", "s")], "u": [(f"{x}.z", "u"), (f"{x}.s", "u"), (f"{x}.a", "u")],
            "a": [(f"{x}.u", "a")],
        }
        out = []
        for state in fields:
            ways = [plus(f"{x}.{state}", "3", "D")]
            for before, initial in into[state]:
                ways.append(f"case when {r}.code = '{initial}' then {plus(before, extra, 'K', kept)} end")
            if state == "u":
                ways += [f"case when {stay} then {plus(f'{x}.{b}', f'2 + {extra}', 'R', as_user)} end" for b in "zsa"]
            if state == "a":
                ways.append(f"case when {stay} then {plus(f'{x}.u', f'2 + {extra}', 'R', as_helper)} end")
            out.append(f"'{state}': least({', '.join(ways)})" if len(ways) > 1 else f"'{state}': {ways[0]}")
        return "{'code': '', 'late': 0, 'pos': 0, " + ", ".join(out) + "}"

    def opened(x: str) -> str:
        return "{'code': '', 'late': 0, 'pos': 0, " + ", ".join(f"'{k}': {v}" for k, v in inserted(x).items()) + "}"

    null = ", ".join(f"'{f}': cast(null as varchar)" for f in fields)
    # Every row stands twice in the list: once to insert before it, once to pass it. Two insertions
    # in a row never pay: they lead back to the state before, or past a system row that costs less to delete.
    return rf"""
with told as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        [cast(ord(c) as bigint) for c in string_split(
            coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), '')] as b
    from conversations
),
marked as (select *, {_crc32_sql("b")} % 20 as kind from told),
rows as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when kind = 3 then [0, 1] else [0] end) as copy
    from marked where kind <> 0
),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as seen
    from rows
),
faulty as (
    select *, case when seen = '' then 'blank'
        when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
        when right(seen, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
        lag(role[1]) over (partition by conv_id order by pos) || role[1] as pair
    from placed
),
listed as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, list(role order by pos) as roles,
        list(text order by pos) as texts,
        list({{'code': case when fault in ('blank', 'duplicate') then '-' else role[1] end,
            'late': cast(fault = 'truncated' as int), 'pos': cast(pos as int), {null}}} order by pos) as steps
    from faulty group by conv_id
),
walked as (
    select *, list_reduce(
        list_append(list_prepend({{'code': '', 'late': 0, 'pos': 0, 'z': '000000' || chr(9), 's': cast(null as varchar),
            'u': cast(null as varchar), 'a': cast(null as varchar)}},
            flatten([[{{'code': '+', 'late': 0, 'pos': 0, {null}}}, r] for r in steps])),
            {{'code': '+', 'late': 0, 'pos': 0, {null}}}),
        lambda x, r: case when r.code = '+' then {opened("x")} else {passed("x", "r")} end
    ) as last from listed
),
best as (select *, least(last.z, last.a) as path from walked),
repaired as (
    select *, [case p[1] when 'i' then 'user:' when 'j' then 'assistant:'
        when 'k' then roles[cast(p[2:] as int)] || ':' || texts[cast(p[2:] as int)]
        when 'u' then 'user:' || texts[cast(p[2:] as int)] else 'assistant:' || texts[cast(p[2:] as int)] end
        for p in string_split(rtrim(split_part(path, chr(9), 2), ';'), ';') if p <> ''] as lines
    from best
)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank,
    coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    cast(coalesce(cast(path[1:6] as int), 0) as bigint) as cost, coalesce(split_part(path[7:], chr(9), 1), '') as audit,
    sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join repaired r on c.conv_id is not distinct from r.conv_id
"""


QUERIES = {
    "op1_best_fit_packing": (op1_best_fit_packing, None),
    "op2_source_mixing": (op2_source_mixing, None),
    "op3_line_dedup": (op3_line_dedup, OP3_SQL),
    "op4_personal_data": (op4_personal_data, None),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_substring_dedup": (op6_substring_dedup, OP6_SQL),
    "op7_exact_top_k": (op7_exact_top_k, OP7_SQL),
    "op8_language_id": (op8_language_id, None),
    "op9_simhash": (op9_simhash, None),
    "op10_license_scan": (op10_license_scan, _op10_sql()),
    "op11_spelling_variants": (op11_spelling_variants, OP11_SQL),
    "op12_approximate_neighbours": (op12_approximate_neighbours, None),
    "op13_conversation_repair": (op13_conversation_repair, _op13_sql()),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

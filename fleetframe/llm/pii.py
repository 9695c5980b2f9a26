"""Personal data by bootstrapped contextual extraction, with DataFrame operations only.

Base spans are found by the four kinds' expressions and are the seeds. The words around a seed
make lexical patterns; the same patterns around other identifier-like tokens make candidates.
Patterns and values form a bipartite graph that is scored in rounds: a pattern is worth the share
of its distinct values that are trusted, a value what its patterns make of it together, and a value
that is trusted enough is a seed of the next round. Tokens that reliable patterns hold are added as
spans of the pattern's kind, where no base span lies. Each distinct value counts once for a
pattern, so copies of a document give no weight, and the sums are partial before any shuffle.

Positions are code points of the whole text. A kind's matches and the stretches between them are
taken by one expression, forwards, without trying a place twice, so long runs cost no more than
their length. A null text is an empty one. Rows are told apart by a number given when the matches
are written, so null and repeated ids are rows like any other. Columns of any name may be present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetframe.llm.common import written

KINDS = ("email", "ip", "card", "phone")
# Fixed expressions; loops give nothing back where that cannot change what they match, and a run
# that has failed is not entered again in its middle.
SPACE = r"\x20\x09-\x0D"
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Any token that holds a digit or an at sign, without the marks around it.
    "token": rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+",
}
GUARDS = {
    "email": "contains(text, '@')",
    "ip": r"text rlike '[0-9]\\.[0-9]'",
    "card": r"text rlike '[0-9][\\x20-]?[0-9][\\x20-]?[0-9]'",
    "phone": "contains(text, '+')",
    "token": "text rlike '[0-9@]'",
}
CONTEXT = 64  # code points beside a match in which its neighbouring words are looked for
ROUNDS = 3
MIN_SUPPORT = 4  # distinct trusted values of a pattern
RELIABLE = 0.8  # share of a pattern's distinct values that are trusted
TRUSTED = 0.8  # of a value
MIN_DIGITS = 7  # of a token without an at sign


def _matches(kind: str) -> Column:
    """The kind's matches with their distance from the one before and the text on either side."""
    expression = EXPRESSIONS[kind].replace("\\", "\\\\")
    parts = f"split(text, '{expression}', -1)"
    found = f"regexp_extract_all(text, '{expression}', 0)"
    beside = f"""transform({parts}, p -> named_struct('gap', cast(char_length(p) as long),
        'head', left(p, {CONTEXT}), 'tail', right(p, {CONTEXT})))"""
    listed = f"""case when {GUARDS[kind]} then zip_with({found}, {beside}, (m, b) ->
        named_struct('value', m, 'gap', b.gap, 'left', b.tail)) end"""
    after = f"case when {GUARDS[kind]} then transform(slice({beside}, 2, 2147483647), b -> b.head) end"
    return F.struct(
        F.lit(kind).alias("kind"), F.expr(listed).alias("found"), F.expr(after).alias("after")
    )


def _luhn(digits: str) -> str:
    return f"""aggregate(sequence(1, length({digits})), 0, (s, i) -> s +
        case when i % 2 = 1 then cast(substring({digits}, -i, 1) as int)
             when substring({digits}, -i, 1) >= '5' then 2 * cast(substring({digits}, -i, 1) as int) - 9
             else 2 * cast(substring({digits}, -i, 1) as int) end) % 10 = 0"""


def valid() -> Column:
    """Whether a match of its kind holds: fixed rules of the kinds."""
    part = r"0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])".replace("0*+", "0*")
    digits = "regexp_replace(value, '[^0-9]', '')"
    return F.expr(
        f"""case kind when 'email' then true
            when 'ip' then value rlike '^{part}(?:\\\\.{part}){{3}}\\\\z'
            when 'card' then length({digits}) between 12 and 19 and {_luhn(digits)}
            when 'phone' then length({digits}) between 9 and 15 else true end"""
    )


def mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, id) of every document, and its valid matches: row, kind, start, end, value, left, right."""
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parted = base.select(
        F.monotonically_increasing_id().alias("row"), "id", *[_matches(k).alias(k) for k in EXPRESSIONS]
    )
    kept = [
        F.when(F.size(F.col(k)["found"]) > 0, F.col(k)).alias(k) for k in EXPRESSIONS
    ]
    rows = written(parted.select("row", "id", *kept), "matches")
    listed = None
    for kind in EXPRESSIONS:
        one = rows.where(F.col(kind).isNotNull()).select(
            "row", F.lit(kind).alias("kind"),
            F.posexplode(F.arrays_zip(F.col(kind)["found"].alias("found"), F.col(kind)["after"].alias("after"))).alias("no", "m"),
        ).where("m.found.value is not null")
        listed = one if listed is None else listed.unionByName(one)
    so_far = Window.partitionBy("row", "kind").orderBy("no")
    placed = listed.select(
        "row", "kind", "no", F.col("m.found.value").alias("value"), F.col("m.found.gap").alias("gap"),
        F.col("m.found.left").alias("left"), F.col("m.after").alias("right"),
    ).withColumn("end", F.sum(F.col("gap") + F.char_length("value")).over(so_far))
    spans = placed.select(
        "row", "kind", "value", (F.col("end") - F.char_length("value")).alias("start"), "end", "left", "right"
    )
    return rows.select("row", "id"), spans.where(valid())


def _trimmed(tokens: DataFrame) -> DataFrame:
    """Candidate tokens without punctuation around them, if they look like an identifier."""
    lead = F.char_length(F.regexp_extract("value", r"^[^\p{L}\p{N}+]*", 0))
    bare = F.regexp_extract("value", r"^[^\p{L}\p{N}+]*(.*?)[^\p{L}\p{N}]*\z", 1)
    out = tokens.withColumn("start", F.col("start") + lead).withColumn("value", bare)
    return out.withColumn("end", F.col("start") + F.char_length("value")).where(
        F.col("value").contains("@")
        & (F.char_length("value") > 2)
        | (F.regexp_count("value", F.lit("[0-9]")) >= MIN_DIGITS)
    )


def _patterns() -> Column:
    """The two words before; the word before with the word after: lower case, letters and digits."""
    word = r"([^\x20\x09-\x0D]+)"
    before = F.regexp_extract(F.lower("left"), rf"{word}[\x20\x09-\x0D]+{word}[\x20\x09-\x0D]*\z", 0)
    last = F.regexp_extract(F.lower("left"), rf"{word}[\x20\x09-\x0D]*\z", 1)
    next_ = F.regexp_extract(F.lower("right"), rf"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+{word}", 1)
    clean = lambda c: F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))
    return F.filter(
        F.array(
            F.when(F.length(before) > 0, F.concat(F.lit("2:"), clean(before))),
            F.when((F.length(last) > 0) & (F.length(next_) > 0), F.concat(F.lit("1:"), last, F.lit(" _ "), next_)),
        ),
        lambda p: p.isNotNull(),
    )


def _free(spans: DataFrame) -> DataFrame:
    """Tokens on which no base span lies: by the ends before and the starts after, in one pass."""
    is_base = F.col("kind") != "token"
    rank, spans_of = F.when(is_base, 0).otherwise(1), Window.partitionBy("row")
    # Both look back, one of them from the end: a frame that looks ahead is summed anew each row.
    earlier = (Window.unboundedPreceding, -1)
    before = spans_of.orderBy("start", rank).rowsBetween(*earlier)
    after = spans_of.orderBy(F.col("start").desc(), rank.desc()).rowsBetween(*earlier)
    return (
        spans.withColumn("_end", F.max(F.when(is_base, F.col("end"))).over(before))
        .withColumn("_next", F.min(F.when(is_base, F.col("start"))).over(after))
        .where(~is_base)
        .where(F.coalesce(F.col("_end") <= F.col("start"), F.lit(True)))
        .where(F.coalesce(F.col("_next") >= F.col("end"), F.lit(True)))
        .drop("_end", "_next")
    )


def scored(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Reliable patterns (pattern, for_kind, score) of the graph of distinct (pattern, value).

    `seeds` has the trusted (value, for_kind).
    """
    trusted, reliable = seeds, None
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("held"))
    for _ in range(rounds):
        support = (
            edges.join(trusted.withColumnRenamed("value", "_v"), F.col("value") == F.col("_v"))
            .groupBy("pattern", "for_kind")
            .agg(F.count(F.lit(1)).alias("support"))
            .where(F.col("support") >= MIN_SUPPORT)
        )
        reliable = written(
            support.join(sizes.withColumnRenamed("pattern", "_p"), F.col("pattern") == F.col("_p"))
            .select("pattern", "for_kind", (F.col("support") / F.col("held")).alias("score"))
            .where(F.col("score") >= RELIABLE),
            "patterns",
        )
        # What no pattern vouches for stays at zero; patterns that agree add up.
        doubt = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.99))))
        found = (
            edges.join(reliable.withColumnRenamed("pattern", "_p"), F.col("pattern") == F.col("_p"))
            .groupBy("value", "for_kind")
            .agg((1 - F.exp(doubt)).alias("trust"))
            .where(F.col("trust") >= TRUSTED)
        )
        trusted = written(seeds.unionByName(found.select("value", "for_kind")).distinct(), "trusted")
    return reliable


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, id) of every document, and all spans: row, kind, start, end, value, base (boolean)."""
    rows, matches = mentions(docs, key, text)
    matches = written(matches, "mentions")
    base = matches.where("kind <> 'token'")
    tokens = _free(base.unionByName(_trimmed(matches.where("kind = 'token'"))))
    contexts = written(
        base.unionByName(tokens).select(
            "row", "kind", "start", "end", F.lower("value").alias("value"), _patterns().alias("patterns")
        ),
        "contexts",
    )
    edges = written(
        contexts.select(F.explode("patterns").alias("pattern"), "value").distinct(), "edges"
    )
    seeds = written(
        contexts.where("kind <> 'token'").select("value", F.col("kind").alias("for_kind")).distinct(), "seeds"
    )
    reliable = scored(edges, seeds).withColumnRenamed("pattern", "_p")
    added = (
        contexts.where("kind = 'token'")
        .select("row", "start", "end", "value", F.explode("patterns").alias("pattern"))
        .join(reliable, F.col("pattern") == F.col("_p"))
        .groupBy("row", "start", "end", "value")
        .agg(F.max_by("for_kind", F.struct("score", "for_kind")).alias("kind"))
    )
    columns = ["row", "kind", "start", "end", "value"]
    return rows, base.select(*columns, F.lit(True).alias("base")).unionByName(
        added.select(*columns, F.lit(False).alias("base"))
    )


def span_digest(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document: counts and digest of its base spans, all spans as text."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    text = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    entry = F.struct("start", rank.alias("rank"), "end", text.alias("text"))
    per_row = spans.groupBy(F.col("row").alias("_row")).agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("base"), entry))).alias("own"),
        F.array_sort(F.collect_list(entry)).alias("all"),
        F.count(F.when(~F.col("base"), 1)).alias("n_added"),
    )
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda e: e["text"]), ","), F.lit(""))
    return rows.join(per_row, F.col("row") == F.col("_row"), "left").select(
        "id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("own")), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"),
    )

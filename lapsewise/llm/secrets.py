"""Secrets in texts: known forms, and parts of credentials that only count together. Built-in expressions only.

Spans of a kind are the matches of its pattern; their places are sums of the lengths of matches and of what lies between
them. Parts of credentials are weak by themselves: an access identifier, a secret, an endpoint. The parts of a document
meet in an interval join, a sweep over its spans in order of their starts: a weak part stays if the parts that complete
it lie within ``SCOPE`` code points of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm import shared


def _either(word: str) -> str:
    """A pattern for the word with letters in either case (A-Z only)."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def _given(*words: str) -> str:
    """Words, then a colon or equals sign, with quotes and blanks as they may be."""
    return "(" + "|".join(_either(w) for w in words) + r""")["']?\x20*[:=]\x20*["']?"""


#: The known forms, in the order in which kinds are listed.
BASE = {
    "assign": _given("password", "passwd", "secret", "token", "api_?key") + "([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
}
LEAST_ASSIGNED = 6

#: Parts that need others. Schemes of an endpoint are listed so that a search starts at few places.
WEAK = {
    "identifier": _given("user", "username", "user_name", "login", "client_?id", "account") + "([A-Za-z0-9_.@-]{3,})",
    "endpoint": r"(?:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._@:-]+[A-Za-z0-9]",
    "key": _given("pwd", "pass", "auth", "key", "credential") + "([A-Za-z0-9+/_.=-]{6,})",
}
SCOPE = 200

KINDS = [*BASE, *WEAK]
IDENTIFIERS = ["access", "identifier"]
SECRETS = ["assign", "hex", "key"]


def _matches(text: Column, kind: str) -> Column:
    """For each match: code points between it and the match before, its length, and whether it counts."""
    pattern = F.lit((BASE | WEAK)[kind])
    between = F.transform(F.split(text, (BASE | WEAK)[kind], -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counts = F.transform(sizes, lambda x: F.lit(True))
    if kind == "assign":
        value = F.regexp_extract_all(text, pattern, F.lit(2))
        counts = F.transform(value, lambda x: F.length(x) >= LEAST_ASSIGNED)
    found = F.zip_with(
        F.arrays_zip(F.slice(between, 1, F.size(sizes)).alias("gap"), sizes.alias("size")),
        counts,
        lambda at, ok: F.struct(at["gap"].alias("gap"), at["size"].alias("size"), ok.alias("ok")),
    )
    return F.when(text.rlike((BASE | WEAK)[kind]), found)


def found(docs: DataFrame) -> DataFrame:
    """The whole texts read once: doc_id, ``row``, and for each kind its matches (null: none)."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return slim.select("doc_id", "row", *[_matches(F.col("text"), k).alias(k) for k in KINDS])


def spans(matches: DataFrame) -> DataFrame:
    """A row per span that counts: row, ``nth`` (of the kind), ``kind``, start and end in code points."""
    listed = [
        matches.where(F.col(kind).isNotNull()).select("row", F.lit(n).alias("nth"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("place", "m"))
        for n, kind in enumerate(KINDS)
    ]
    every = reduce(DataFrame.unionByName, listed)
    so_far = Window.partitionBy("row", "nth").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(so_far)
    placed = every.select("row", "nth", "kind", end.alias("end"), "m.size", "m.ok")
    return placed.where("ok").select("row", "nth", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Known forms, and the weak parts that are completed: all columns of ``spans``.

    A key needs an identifier in its scope, an identifier a secret, an endpoint both. A weak part that overlaps a known
    form is that form's and not reported again.
    """
    place = ("start", "nth", "end")
    # both frames grow row by row, so that a document's sweep takes time in proportion to its spans
    before = Window.partitionBy("row").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(*map(F.desc, place)).rowsBetween(Window.unboundedPreceding, -1)

    def near(kinds: list[str], reach: int) -> Column:
        """Whether a span of the kinds ends after start - reach and begins before end + reach."""
        of_kind = F.col("kind").isin(kinds)
        left = F.max(F.when(of_kind, F.col("end"))).over(before) > F.col("start") - reach
        right = F.min(F.when(of_kind, F.col("start"))).over(after) < F.col("end") + reach
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    judged = parts.select(
        "*",
        near(list(BASE), 0).alias("taken"),
        near(IDENTIFIERS, scope).alias("identified"),
        near(SECRETS, scope).alias("secret"),
    )
    complete = (
        F.when(F.col("kind") == "key", F.col("identified"))
        .when(F.col("kind") == "identifier", F.col("secret"))
        .when(F.col("kind") == "endpoint", F.col("identified") & F.col("secret"))
    )
    return judged.where(F.col("kind").isin(list(BASE)) | (complete & ~F.col("taken"))).select(parts.columns)


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, ``row`` and ``spans``, its spans in order of start, then kind.

    Each span has kind, start and end (code points, end exclusive). Null and empty texts have none, and so has every
    row's list where nothing is found; repeated rows are scanned one by one; a null doc_id stays null. Other columns are
    not read. An empty table gives no rows. ``docs`` is read once, whole; only spans are shuffled.
    """
    matches = shared.stored(found(docs))
    parts = linked(spans(matches))
    lists = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "nth", "end", "kind"))).alias("spans"))
    joined = matches.select("doc_id", "row").join(lists, "row", "left")
    return joined.select(
        "doc_id",
        "row",
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, nth: int, end: bigint, kind: string>>")).alias("spans"),
    )


def listing(spans: Column, kinds: list[str]) -> Column:
    """Spans of the kinds as kind:start:end, comma-joined."""
    some = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sql() -> str:
    """The same scan in SQL (regular expressions of RE2), as the numbered query returns it."""
    quoted = {k: p.replace("'", "''") for k, p in (BASE | WEAK).items()}
    arms = "\n  union all ".join(
        f"""select id, doc_id, {n} as nth, '{k}' as kind,
       unnest(list_transform(string_split_regex(text, '{quoted[k]}')[:-2], lambda x: len(x))) as gap,
       unnest(list_transform(regexp_extract_all(text, '{quoted[k]}'), lambda x: len(x))) as size,
       unnest(list_transform(regexp_extract_all(text, '{quoted[k]}', {2 if k == "assign" else 0}), lambda x: len(x) >= {LEAST_ASSIGNED if k == "assign" else 0})) as ok,
       generate_subscripts(regexp_extract_all(text, '{quoted[k]}'), 1) as place
  from docs where regexp_matches(text, '{quoted[k]}')"""
        for n, k in enumerate(KINDS)
    )
    near = lambda kinds, reach: (
        f"coalesce(max(\"end\") filter (where kind in ({kinds})) over before > start - {reach}, false) or "
        f"coalesce(min(start) filter (where kind in ({kinds})) over after < \"end\" + {reach}, false)"
    )
    names = lambda kinds: ", ".join(f"'{k}'" for k in kinds)
    text_of = "string_agg(kind || ':' || start || ':' || \"end\", ',' order by start, nth, \"end\")"
    return f"""
with docs as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
matched as ({arms}),
placed as (
  select id, nth, kind, size, ok, sum(gap + size) over (partition by id, nth order by place) as "end" from matched),
parts as (select id, nth, kind, ("end" - size)::bigint as start, "end"::bigint as "end" from placed where ok),
judged as (
  select *, {near(names(BASE), 0)} as taken, {near(names(IDENTIFIERS), SCOPE)} as identified, {near(names(SECRETS), SCOPE)} as secret
  from parts
  window before as (partition by id order by start, nth, "end" rows between unbounded preceding and 1 preceding),
         after as (partition by id order by start, nth, "end" rows between 1 following and unbounded following)),
reported as (
  select * from judged
  where kind in ({names(BASE)})
     or not taken and (kind = 'key' and identified or kind = 'identifier' and secret or kind = 'endpoint' and identified and secret)),
lists as (
  select id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
         count(*) filter (where kind = 'hex') as n_hex, {text_of} filter (where kind in ({names(BASE)})) as base, {text_of} as spans
  from reported group by id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join lists using (id)
"""

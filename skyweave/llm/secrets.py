"""Secret scans with DataFrame operations alone: patterns, then how many owners hold a value.

Patterns find candidates; hashes of their values are counted by distinct
repositories and owners over the whole corpus.  A value that many of them hold
is an example that was copied around; one that stays with its owner looks live.
Base spans are all reported; spans of the further kinds only where they look live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.llm.shared import Scratch, once, restrict


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value, the least length of that, and more that the value must match.

    ``hint``: what a text holds that has a match, if that is cheaper to look for.
    ``distinct``: least number of different characters of the value.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    also: tuple[str, ...] = ()
    hint: str | None = None
    distinct: int = 0


_KEYWORD = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
#: The base kinds, in the order of the report.  Runs of one class are matched from their least length on, which leaves the same runs.
BASE = (
    Kind("assign", rf"({_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, hint=_KEYWORD),
    Kind("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: Public forms of service tokens, key blocks, logins in addresses; then long mixed strings without a name.
FURTHER = (
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh[pousr]_"),
    Kind("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Kind("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", hint="k_live_"),
    Kind("google", r"AIza[A-Za-z0-9_-]{35,}", hint="AIza"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hint=r"\.eyJ"),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+", hint="PRIVATE KEY-----"),
    Kind("login", r"://[A-Za-z0-9._~%+-]+:([A-Za-z0-9._~%!$&*+,;=-]+)@", 1, 6, hint="://"),
    Kind("opaque", r"[A-Za-z0-9+/_-]{24,}", also=("[a-z]", "[A-Z]", "[0-9]"), distinct=12),
)


@dataclass
class Settings:
    """A value looks live with at most ``owners`` owners and ``repositories`` repositories.

    ``owner`` and ``repository``: columns of the documents; a document is a
    repository by itself unless another column says more.
    """

    owners: int = 1
    repositories: int = 3
    owner: str = "source"
    repository: str = "doc_id"
    kinds: tuple[Kind, ...] = BASE + FURTHER


_BLOCK = 256
_STEP = "cast(named_struct('to', 0, 'spans', array()) as struct<to:int,spans:array<struct<start:int,stop:int,value:string>>>)"


def _ends(steps: Column) -> Column:
    """Spans (start, stop, value) from (gap, value) steps, in time about linear: sums within blocks, then of blocks."""

    def block(own: Column) -> Column:
        def add(done: Column, step: Column) -> Column:
            start = done["to"] + step["gap"]
            stop = start + F.length(step["value"])
            return F.struct(stop.alias("to"), F.concat(done["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"), step["value"].alias("value")))).alias("spans"))

        return F.aggregate(own, F.expr(_STEP), add)

    def moved(blocks: Column) -> Column:
        def shift(own: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(blocks, 1, i), F.lit(0), lambda at, b: at + b["to"])
            return once(before, lambda at: F.transform(own["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["stop"] + at).alias("stop"), s["value"].alias("value"))))

        return F.flatten(F.transform(blocks, shift))

    def cut(every: Column) -> Column:
        count = F.ceil(F.size(every) / _BLOCK).cast("int")
        return once(F.transform(F.sequence(F.lit(0), count - 1), lambda k: block(F.slice(every, k * _BLOCK + 1, _BLOCK))), moved)

    return once(steps, cut)


def matches(text: Column, kind: Kind) -> Column:
    """(start, stop, value) of all leftmost matches of a kind that do not overlap, in code points, ``stop`` exclusive.

    Spark gives the matches and what is between them, but no places; these are
    sums of lengths.
    """
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, kind.pattern, -1), lambda gap: F.length(gap))
        steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda value, gap: F.struct(gap.alias("gap"), value.alias("value")))
        return F.when(F.size(found) > 0, _ends(steps)).otherwise(none)

    every = once(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), placed)
    if kind.hint:
        every = F.when(text.rlike(kind.hint), every).otherwise(none)
    return every


def _secrets(text: Column, number: int, kind: Kind) -> Column:
    """(start, number, stop, hash) of the matches of a kind whose value will do."""

    def own(span: Column) -> Column:
        return F.regexp_extract(span["value"], kind.pattern, kind.group) if kind.group else span["value"]

    def good(span: Column) -> Column:
        out = F.length(own(span)) >= kind.least
        for more in kind.also:
            out = out & own(span).rlike(more)
        return out & (F.size(F.array_distinct(F.split(own(span), ""))) >= kind.distinct) if kind.distinct else out

    kept = F.filter(matches(text, kind), good)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["stop"].alias("stop"), F.unhex(F.sha2(own(s), 256)).alias("hash")))


def candidates(docs: DataFrame, settings: Settings) -> DataFrame:
    """(row, doc_id, owner, repository, found): all candidates of each row, as (start, kind, stop, hash)."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*(_secrets(F.col("text"), k, kind) for k, kind in enumerate(settings.kinds)))
    named = docs.select("doc_id", F.col(settings.owner).cast("string").alias("owner"), F.col(settings.repository).cast("string").alias("repository"), text.alias("text"))
    return named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", found.alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every value; null owners and repositories are one each.

    Distinct (value, owner, repository) rows come first, so a value that a third
    of the corpus holds is dealt by all three; its counts then meet as partial
    sums.
    """
    each = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, spans, n_live, n_copied) for each row of ``docs`` (doc_id, text, and the columns of owner and repository).

    ``spans``: (start, kind, stop, live) by start, then kind: all base spans, and
    those of the further kinds that look live.  ``kind`` is the place in
    ``settings.kinds``.  Kinds are searched apart, so spans of different kinds
    may overlap.  ``n_live``, ``n_copied``: candidates of the row, reported or
    not, whose value looks live, and those whose value was copied around.

    A null or empty text has no spans; rows that repeat are rows each, though
    one repository; null owners and null repositories count as one; other
    columns are ignored; an empty table gives an empty result.  Texts are read
    once and never shuffled.  Values are compared by sha-256 and not kept.  A
    live value has few repositories, so the join back to documents has no hot
    key but where one repository repeats rows; the copied ones are left out of
    it by a map of fixed size.
    """
    settings = settings or Settings()
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.keep(candidates(docs, settings))
    by_value = rows.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    counts = ownership(by_value)
    live = scratch.keep(counts.where((F.col("owners") <= settings.owners) & (F.col("repositories") <= settings.repositories)).select("hash", F.xxhash64("hash").alias("mark")))
    marked = by_value.select("row", "start", "kind", "stop", "hash", F.xxhash64("hash").alias("mark"))
    held = restrict(marked, "mark", live).join(live.select("hash"), "hash")
    by_row = held.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("live"))
    base = [k for k, kind in enumerate(settings.kinds) if kind in BASE]

    def named(span: Column, live: bool) -> Column:
        return F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["stop"].alias("stop"), F.lit(live).alias("live"))

    alive = F.coalesce("live", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))
    basic = F.transform(F.filter("found", lambda s: s["kind"].isin(*base)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    spans = F.concat(F.transform("alive", lambda s: named(s, True)), F.transform(F.array_except(basic, F.col("alive")), lambda s: named(s, False)))
    joined = rows.join(by_row, "row", "left").select("doc_id", "found", alive.alias("alive"))
    return joined.select(
        "doc_id", F.array_sort(spans).alias("spans"), F.size("alive").cast("long").alias("n_live"), (F.size("found") - F.size("alive")).cast("long").alias("n_copied")
    )


def digest(found: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Counts and digest of the base kinds, and all spans as text."""
    settings = settings or Settings()
    names = F.array(*(F.lit(k.name) for k in settings.kinds))
    base = [k for k, kind in enumerate(settings.kinds) if kind in BASE]

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{settings.kinds[k].name}")

    return found.select("doc_id", *map(count, base), F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), "n_live", "n_copied")


def sql(settings: Settings | None = None) -> str:
    """The same with SQL's pattern functions; every row of ``documents`` has its own id."""
    settings = settings or Settings()

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    def one(k: int, kind: Kind) -> str:
        value = f"regexp_extract(m, '{quoted(kind.pattern)}', {kind.group})"
        good = "".join(f" AND regexp_matches(v, '{quoted(x)}')" for x in kind.also) + (f" AND len(list_distinct(string_split(v, ''))) >= {kind.distinct}" if kind.distinct else "")
        return f"""
p{k} AS (SELECT row, regexp_extract_all(text, '{quoted(kind.pattern)}') AS ms, list_transform(string_split_regex(text, '{quoted(kind.pattern)}'), lambda g: length(g)) AS gs FROM d),
q{k} AS (SELECT row, {k} AS kind, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM p{k} WHERE len(ms) > 0),
s{k} AS (SELECT row, kind, {value} AS v, (sum(g + length(m)) OVER (PARTITION BY row ORDER BY i))::BIGINT AS stop, length(m) AS n FROM q{k}),
f{k} AS (SELECT row, kind, stop - n AS start, stop, v FROM s{k} WHERE length(v) >= {kind.least}{good})"""

    kinds = settings.kinds
    names = ", ".join(f"'{k.name}'" for k in kinds)
    base = ", ".join(str(k) for k, kind in enumerate(kinds) if kind in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{kind.name}" for k, kind in enumerate(kinds) if kind in BASE)
    told = "string_agg(([{names}])[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)".replace("{names}", names)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {settings.owner} AS owner, {settings.repository}::VARCHAR AS repository, coalesce(text, '') AS text FROM documents),{",".join(one(k, kind) for k, kind in enumerate(kinds))},
f AS ({" UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(len(kinds)))}),
o AS (SELECT v, count(DISTINCT coalesce(owner, chr(0))) AS owners, count(DISTINCT (coalesce(owner, chr(0)), coalesce(repository, chr(0)))) AS repositories FROM f JOIN d USING (row) GROUP BY v),
l AS (SELECT f.*, owners <= {settings.owners} AND repositories <= {settings.repositories} AS live FROM f JOIN o USING (v)),
r AS (SELECT row, {counts}, {told} FILTER (kind IN ({base})) AS base, {told} FILTER (live OR kind IN ({base})) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM l GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{kind.name}, 0) AS n_{kind.name}" for kind in kinds if kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN r USING (row)
"""

"""Secret scans with corpus-wide ownership: widely copied examples told from an owner's own credentials. Native: DataFrame functions only.

Base patterns find secrets text by text. Beyond them, every candidate value (the values of the base patterns and long runs
of key-like characters) is hashed, and the hashes are summed up over the corpus: in how many repositories, and with how many
owners. A value that `example_owners` owners or more have is an example that people copy. A value of fewer owners that
looks live (long, of letters and digits, of many different characters) is an owner's own: its place is added as a span
of the kind `live`.

Where things run: patterns and places in one pass over the texts, without a shuffle. Only (hash, repository, owner) of
candidates is shuffled, summed up to distinct ones first, so a value that a third of all rows copies is a row a task;
places meet verdicts by a join of plain shuffles that adaptive execution splits at a common value. No text is shuffled.

Places count code points, ends are exclusive. Cases: a null text is an empty one; a row without a match has no spans;
repeated rows each have their own result, and count once as a repository and owner; a null repository or owner is one like
any other; ties (spans of one start) stand in the order of kinds; very long texts are handled as others, a text's list of
matches is summed up in chunks; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, quoted, table, text_of, tidy, written


def either_case(word: str) -> str:
    """A pattern for the ASCII letters of a word in either case, and for nothing else in any engine."""
    return "".join(f"[{x.upper()}{x.lower()}]" if x.isalpha() else x for x in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: Kinds in order of ties, their patterns, the group that is the value, and the least length of it. Runs of one class of
#: characters are found whole, so that their least length can stand in the pattern; a short assignment takes its text with it.
BASE = (
    ("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Runs of letters, digits and signs of keys that are long enough to be one. Every long run of hex digits is in one.
WIDE = ("live", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
ORDER = {kind: i for i, (kind, *_) in enumerate((*BASE, WIDE))}
#: Numbers of a list that are summed up together.
CHUNK = 512


def running(numbers: Column) -> Column:
    """The sums of the first 1, 2, .. of an array of longs; a list is copied for each element of a chunk only."""
    none = F.array().cast("array<bigint>")

    def sums(a: Column) -> Column:
        return F.aggregate(a, none, lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x)))

    def chunked(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda k: F.slice(a, k * CHUNK + 1, F.lit(CHUNK)))
        before = sums(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda t, x: t + x)))
        return F.flatten(F.zip_with(F.transform(chunks, sums), F.concat(F.array(F.lit(0).cast("long")), F.slice(before, F.lit(1), F.size(before) - 1)), lambda c, b: F.transform(c, lambda x: x + b)))

    return F.when(F.size(numbers) <= CHUNK, sums(numbers)).otherwise(chunked(numbers))


def may_match(text: Column, kind: str) -> Column:
    """A cheap test that no text with a match of the kind fails."""
    if kind == "assign":  # most places are passed over by one look at their character
        return (text.contains(":") | text.contains("=")) & text.rlike(f"(?=[AaPpSsTt])({KEYWORDS})[\"']?\\x20*[:=]")
    return text.contains("AKIA") if kind == "access" else text.rlike(WIDE[1])


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """An array of (start, rank, end, kind, value_start, value) of a pattern's matches whose value is long enough, from left to right.

    Gaps and matches alternate, so ends are running sums of their lengths. A value that is a group ends where its match does.
    """
    p = F.lit(pattern)
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    length = lambda x: F.char_length(x).cast("long")
    ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: length(g) + length(m)))
    found = F.transform(
        F.arrays_zip(ends.alias("e"), whole.alias("m"), values.alias("v")),
        lambda x: F.struct((x["e"] - length(x["m"])).alias("start"), F.lit(ORDER[kind]).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind"), (x["e"] - length(x["v"])).alias("value_start"), x["v"].alias("value")),
    )
    kind_of = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value_start:bigint,value:string>>"
    return F.when(may_match(text, kind), F.filter(found, lambda x: F.char_length(x["value"]) >= least)).otherwise(F.array()).cast(kind_of)


def joined(spans: Column) -> Column:
    """Spans in order as text: kind:start:end, separated by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def looks_live(value: Column, least: int = 16, different: int = 8) -> Column:
    """Long enough, with letters and digits, of many different characters."""
    return (F.char_length(value) >= least) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= different)


def hashes(value: Column) -> list[Column]:
    """128 bits that stand for a value in shuffles."""
    return [F.xxhash64(F.lit(seed), value).alias(f"h{seed}") for seed in (1, 2)]


def owned(candidates: DataFrame) -> DataFrame:
    """(h1, h2, repositories, owners) of every candidate hash, from rows with repo and owner; nulls count as one of their own."""
    pairs = candidates.groupBy("h1", "h2", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("h1", "h2", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("h1", "h2").agg(F.sum("repos").alias("repositories"), F.count("*").alias("owners"))


@tidy
def scan_secrets(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = 3) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans of each row; n_live and n_examples count the candidate values of each verdict.

    A value's repositories are the distinct values of repo_col, its owners those of owner_col.
    """
    own = numbered(df)
    at = {n: f"c{df.columns.index(n)}" for n in (text_col, id_col, repo_col, owner_col)}
    texts = own.select(F.col(at[id_col]).alias("id"), F.col(at[repo_col]).cast("string").alias("repo"), F.col(at[owner_col]).cast("string").alias("owner"), text_of(F.col(at[text_col])).alias("text"))
    found = texts.select("id", "repo", "owner", *[matches(F.col("text"), *kind).alias(kind[0]) for kind in (*BASE, WIDE)])
    found = written(found, "matches")  # so that no pattern runs twice
    base = F.concat(*[k for k, *_ in BASE])
    spots = F.array_distinct(F.transform(F.concat(base, F.col("live")), lambda x: F.struct(x["value_start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))))
    told = F.transform(spots, lambda x: F.struct(x["start"], x["end"], looks_live(x["value"]).alias("live"), *[h.alias(n) for n, h in zip(("h1", "h2"), hashes(x["value"]), strict=True)]))
    bare = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    rows = found.select("id", "repo", "owner", *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE], bare.alias("base"), told.alias("spots"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")  # numbers that stay, as they are written
    candidates = rows.where(F.size("spots") > 0).select("row", "repo", "owner", F.explode("spots").alias("x")).select("row", "repo", "owner", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.live").alias("live"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"))
    places, verdicts = written(candidates.select("row", "h1", "h2", "start", "end", "live"), "places"), written(owned(candidates), "owners")
    met = places.join(verdicts.hint("merge"), ["h1", "h2"])
    example, live = F.col("owners") >= example_owners, F.col("live")
    span = F.struct("start", F.lit(ORDER["live"]).alias("rank"), "end", F.lit("live").alias("kind"))
    added = written(met.select("row", F.when(live & ~example, span).alias("span"), example.alias("example")), "verdicts")
    added = added.groupBy("row").agg(F.collect_list("span").alias("added"), F.count_if("example").alias("n_examples"))  # a row's own places
    full = rows.select("row", "id", "n_assign", "n_access", "n_hex", "base").join(added.hint("merge"), "row", "left")
    more = F.coalesce("added", F.array().cast(added.schema["added"].dataType))
    return full.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", more)).alias("spans"),
        F.size(more).cast("long").alias("n_live"), F.coalesce("n_examples", F.lit(0).cast("long")).alias("n_examples"),
    )


def op12_secret_scans(spark, sf_dir):
    """The secrets of every document; a document is a repository, its source the owner."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in SQL: places by running sums over gaps and matches, values instead of hashes."""
    each = []
    for kind, pattern, group, least in (*BASE, WIDE):
        p = pattern.replace("'", "''")
        each.append(f"""SELECT r, '{kind}' AS kind, {ORDER[kind]} AS rank, e - len(m) AS s, e, e - len(v) AS vs, v FROM (
  SELECT r, m, v, sum(len(g) + len(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
    SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS m, unnest(vs) AS v, unnest(gs[:len(w)]) AS g FROM (
      SELECT r, regexp_extract_all(text, '{p}') AS w, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS gs FROM d WHERE regexp_matches(text, '{p}')))) WHERE len(v) >= {least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(each)}),
spots AS (SELECT DISTINCT r, vs, e, v FROM spans),
owners AS (SELECT v, count(DISTINCT coalesce('x' || source, '')) AS n FROM spots JOIN d USING (r) GROUP BY v),
added AS (SELECT r, 'live' AS kind, {ORDER['live']} AS rank, vs AS s, e FROM spots JOIN owners USING (v) WHERE n < 3 AND len(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8),
base AS (SELECT r, kind, rank, s, e FROM spans WHERE kind <> 'live'),
texts AS (SELECT r, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank, e) AS spans, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank, e) FILTER (kind <> 'live') AS base,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'live') AS n_live FROM (FROM base UNION ALL FROM added) GROUP BY r),
examples AS (SELECT r, count(*) AS n FROM spots JOIN owners o USING (v) WHERE o.n >= 3 GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(examples.n, 0) AS n_examples
FROM d LEFT JOIN texts USING (r) LEFT JOIN examples USING (r)
"""


SQL = _sql()

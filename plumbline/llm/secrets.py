"""Operator 4 [native], secret scans with corpus-wide ownership frequency.

Candidates are found by fixed patterns.  Each value that looks like a credential is hashed, and the hashes are counted
over the whole corpus by distinct repositories and distinct owners: a value that many owners hold is a copied example,
one that few hold is a live-looking credential, and its places are added to the spans.

Only DataFrame functions run: positions come from the lengths between matches (split) and of the matches
(regexp_extract_all), summed in a window over one row's matches.  Texts are scanned once; what is shuffled are the
matches.  Counts are partial before each shuffle, so a value that a third of all rows hold is one row per task.

Defined results: null text counts as empty.  Positions are code points, ends exclusive.  Rows without matches have
zero counts and empty spans.  A null repository counts as one repository (and owner) of its own.  Repeated rows are
scanned each; null doc_id and extra columns are harmless; a table without the column of repositories counts as one
repository; an empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, empty_if_null, in_files, stored

#: The patterns of the three kinds (fixed values); a match of `assign` counts from 12 characters of group 2.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}+"
HEX = "[0-9a-f]{16,}+"
ASSIGN_LENGTH = 12

#: What the method looks at: whole runs of 16 and more of these characters with a letter and a digit among them.
RUN = "[A-Za-z0-9_+/=-]"
VALUE = rf"(?<!{RUN})(?={RUN}*[0-9])(?={RUN}*[A-Za-z]){RUN}{{16,}}+"

#: The kinds in order; `live` is what the method adds.
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "live": VALUE}

#: A run or an assigned value is cut at "=" and "/" down to the credential, the same in every notation; "=" stays as
#: padding at the end.  PART: 16 and more characters without either, with a letter and a digit.  BASE64: 32 and more with
#: "/" inside, of both cases and digits, none of whose parts is a word or a number.  PATH: what has no PART, whole.
_C, _S, _B = "[A-Za-z0-9_+-]", "[A-Za-z0-9_+/-]", "[A-Za-z0-9+/]"
_WORD = "(?:[A-Z][a-z]{2,}|[a-z]{3,}|[A-Z]{3,}|[0-9]{3,})"
_PAD = r"(?:={1,2}(?![A-Za-z0-9_+/=.-]))?"
PART = rf"(?<!{_C})(?={_C}*[0-9])(?={_C}*[A-Za-z]){_C}{{16,}}+"
BASE64 = rf"(?<!{_S})(?={_B}*/)(?={_B}*[0-9])(?={_B}*[a-z])(?={_B}*[A-Z])(?!(?:{_B}*/)?{_WORD}(?:/|(?!{_S}))){_B}{{32,}}+(?!{_S})"
PATH = rf"(?<!{_S})(?!{_S}*?{PART})(?={_S}*[0-9])(?={_S}*[A-Za-z]){_S}{{16,}}+"
CREDENTIAL = rf"(?:{BASE64}|{PART}|{PATH}){_PAD}"

#: What a bare credential must have to be blanked: 8 and more letters and digits together that change between the two
#: at least twice, or the form of base64.
SHAPE = rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{{8}})[A-Za-z0-9]*?(?:[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9])|{BASE64}"

#: The kinds of candidates that `verdicts` judges; `value` is a run found by VALUE.
CANDIDATES = ["assign", "access", "hex", "value"]

#: A value that more owners or more repositories than this hold is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 3


def owner_of(repository: Column) -> Column:
    """The part of a repository's name before its first slash."""
    return F.substring_index(repository, "/", 1)


def _repository(docs: DataFrame, repository: str) -> Column:
    """The column of repositories; without one all rows are of one repository."""
    return empty_if_null(repository) if repository in docs.columns else F.lit("")


def _matches(text: Column, pattern: str) -> Column:
    """The code points between matches (one more than matches) and the matches; null where there is none."""
    found = F.struct(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )
    return F.when(text.rlike(pattern), found)


def scanned(docs: DataFrame, doc_id: str | None, text: str, repository: str, kinds: list[str]) -> DataFrame:
    """The matches of each row, stored; `serial` tells rows apart from then on."""
    x = F.col("text")
    own = docs[f"`{doc_id}`"].cast("long") if doc_id else F.lit(None).cast("long")
    rows = docs.select(own.alias("doc_id"), empty_if_null(text).alias("text"), _repository(docs, repository).alias("repository"))
    found = F.array(*[F.struct(F.lit(list(KINDS).index(k)).alias("kind"), _matches(x, KINDS[k]).alias("m")) for k in kinds])
    return stored(rows.select(F.monotonically_increasing_id().alias("serial"), "doc_id", "repository", F.filter(found, lambda k: k["m"].isNotNull()).alias("found")), "matches")


def spans(rows: DataFrame) -> DataFrame:
    """A row for each match that counts: serial, kind, start, stop, hit."""
    each = rows.where(F.size("found") > 0).select("serial", "doc_id", "repository", F.explode("found").alias("f"))
    each = each.select("serial", "doc_id", "repository", "f.kind", F.posexplode(F.arrays_zip(F.slice("f.m.gaps", 1, F.size("f.m.hits")).alias("gap"), F.col("f.m.hits").alias("hit"))).alias("i", "z"))
    each = each.select("serial", "doc_id", "repository", "kind", "i", F.col("z.gap").cast("long").alias("gap"), F.col("z.hit").alias("hit"))
    before = Window.partitionBy("serial", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("stop", F.sum(F.col("gap") + F.length("hit")).over(before)).withColumn("start", F.col("stop") - F.length("hit"))
    short = (F.col("kind") == 0) & (F.length(F.regexp_extract("hit", ASSIGN, 1)) < ASSIGN_LENGTH)
    return each.where(~short).select("serial", "doc_id", "repository", "kind", "i", "start", "stop", "hit")


def ownership(values: DataFrame) -> DataFrame:
    """(hash, repositories, owners, places) of the values in `hit`, over the whole corpus."""
    each = values.groupBy(F.md5("hit").alias("hash"), owner_of(F.col("repository")).alias("owner"), "repository").agg(F.count(F.lit(1)).alias("places"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("places").alias("places"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("places").alias("places"))


def live_hashes(values: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """ownership with `live`: held by few owners and repositories."""
    return ownership(values).withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))


def _joined(found: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, KINDS)), found["kind"] + 1)
    return F.concat_ws(":", name, found["start"], found["stop"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row, with n_live and n_copied of the method."""
    rows = scanned(docs, doc_id, text, repository, list(KINDS))
    found = stored(spans(rows), "spans")
    values = found.where("kind = 3").withColumn("hash", F.md5("hit"))
    judged = values.join(live_hashes(values, max_owners, max_repositories).select("hash", "live"), "hash").drop("hash")
    every = found.where("kind < 3").withColumn("live", F.lit(None).cast("boolean")).unionByName(judged)
    span = F.struct("start", "kind", "stop")
    per_row = every.groupBy("serial", "doc_id").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS) if k != "live"],
        F.sort_array(F.collect_list(F.when(F.col("kind") < 3, span))).alias("base"),
        F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), span))).alias("every"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_copied"),
    )
    text_of = lambda c: F.array_join(F.transform(c, _joined), ",")
    some = per_row.select("serial", "doc_id", "n_assign", "n_access", "n_hex", F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("every").alias("spans"), "n_live", "n_copied")
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    nothing = [F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied")]
    rest = rows.join(found.select("serial").distinct(), "serial", "left_anti").select("serial", "doc_id", *zero, *nothing)
    return some.unionByName(rest).drop("serial")


def credentials(found: DataFrame) -> DataFrame:
    """The credentials in the matches of `spans`: `value` and its place `at` to `end`, beside the match's own.

    A bare run has one for each of its parts, all else one: of an assigned value the longest part decides, and short
    values go whole, without "=" before and "." after them."""
    columns = found.columns
    bare = found.where("kind = 3").select(*columns, _matches(F.col("hit"), CREDENTIAL).alias("m"))
    bare = bare.select(*columns, F.posexplode(F.arrays_zip(F.slice("m.gaps", 1, F.size("m.hits")).alias("gap"), F.col("m.hits").alias("value"))).alias("j", "z"))
    before = Window.partitionBy("serial", "i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    bare = bare.withColumn("end", F.col("start") + F.sum(F.col("z.gap") + F.length("z.value")).over(before))
    bare = bare.select(*columns, F.col("z.value").alias("value"), (F.col("end") - F.length("z.value")).alias("at"), "end")
    whole = F.when(F.col("kind") == 0, F.regexp_extract("hit", ASSIGN, 1)).otherwise(F.col("hit"))
    bounded = F.regexp_replace(whole, r"^=+(?=[^=])|(?<=[^.])\.+$", "")
    parts = F.transform(F.regexp_extract_all(bounded, F.lit(CREDENTIAL), F.lit(0)), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    own = F.when(F.col("kind") == 0, F.coalesce(F.array_max(parts)["p"], bounded)).otherwise(whole)
    end = F.col("stop") - F.length(F.regexp_extract(whole, r"(?<=[^.])(\.+)$", 1))
    rest = found.where("kind < 3").select(*columns, own.alias("value"), (end - F.length(bounded)).alias("at"), end.alias("end"))
    return bare.unionByName(rest)


def judged(each: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, corpus: DataFrame | None = None) -> DataFrame:
    """`credentials` with `live`, from one ownership count over all kinds; a place found by several kinds counts once.

    `corpus` are the credentials to count, if not these; one that it does not hold has one owner and is live."""
    once = (each if corpus is None else corpus).select("serial", "repository", "at", "end", F.col("value").alias("hit")).distinct()
    verdicts = live_hashes(once, max_owners, max_repositories).select("hash", "live")
    found = each.withColumn("hash", F.md5("value")).join(verdicts, "hash", "left").drop("hash")
    return found.withColumn("live", F.coalesce("live", F.lit(True)))


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, verdicts, n_live and n_copied of each row: every candidate of every kind as kind:start:stop:verdict.

    The places are those of the matches, and of the credential for kind `value`; n_live and n_copied count places of credentials, each once."""
    rows = scanned(docs, doc_id, text, repository, list(KINDS))
    found = stored(credentials(spans(rows)), "credentials")
    each = judged(found, max_owners, max_repositories)
    own = lambda c, place: F.when(F.col("kind") == 3, F.col(place)).otherwise(F.col(c)).alias(c)
    one = F.struct(own("start", "at"), "kind", own("stop", "end"), "at", "end", "live")
    places = lambda live: F.size(F.array_distinct(F.transform(F.filter("all", lambda v: v["live"] == live), lambda v: F.struct(v["at"], v["end"])))).cast("long")
    word = lambda v: F.concat_ws(":", F.element_at(F.array(*map(F.lit, CANDIDATES)), v["kind"] + 1), v["start"], v["stop"], F.when(v["live"], "live").otherwise("copied"))
    some = each.groupBy("serial", "doc_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    some = some.select("serial", "doc_id", F.array_join(F.transform("all", word), ",").alias("verdicts"), places(F.lit(True)).alias("n_live"), places(F.lit(False)).alias("n_copied"))
    rest = rows.join(found.select("serial").distinct(), "serial", "left_anti")
    rest = rest.select("serial", "doc_id", F.lit("").alias("verdicts"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    return some.unionByName(rest).drop("serial")


def _unpacked(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """The columns of docs from `row`, with the new `text` and, where `any` is true, its length in n_chars."""
    columns = []
    for f in docs.schema.fields:
        c = F.col(f"row.`{f.name}`")
        if f.name == text:
            c = F.col("text").cast(f.dataType)
        elif f.name == "n_chars" and f.dataType.typeName() in ("long", "integer"):
            c = F.when(F.col("any"), F.length("text").cast(f.dataType)).otherwise(c)
        columns.append(c.alias(f.name))
    return changed.select(*columns)


def cleaned(docs: DataFrame, text: str = "text", repository: str = "source", mark: str = "[REDACTED]", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, corpus: DataFrame | None = None) -> DataFrame:
    """docs with the live credentials of all kinds replaced by `mark`, overlapping ones by one; all else stays.

    Owners are counted over `corpus`, the table that docs were taken from, with the same columns: what filters and
    deduplication took away still tells a published example from a credential.  Without it they are counted over docs.

    Names around a credential stay.  A bare run goes only if it has the shape of one (SHAPE); paths and slugs have not.
    Rows without a candidate pass untouched; the others are stored with their matches and joined to the verdicts."""
    x = empty_if_null(text)
    possible = x.rlike("|".join(f"(?:{p})" for p in KINDS.values()))
    found = F.array(*[F.struct(F.lit(i).alias("kind"), _matches(F.col("text"), p).alias("m")) for i, p in enumerate(KINDS.values())])
    some = docs.where(possible).select(F.struct("*").alias("row"), x.alias("text"), _repository(docs, repository).alias("repository"))
    some = stored(some.select(F.monotonically_increasing_id().alias("serial"), F.lit(None).cast("long").alias("doc_id"), "row", "text", "repository", F.filter(found, lambda k: k["m"].isNotNull()).alias("found")), "candidates")
    listed = lambda rows, kind: stored(in_files(credentials(spans(rows)), rows.count()), kind)
    every = None if corpus is None else listed(scanned(corpus, None, text, repository, list(KINDS)), "corpus-credentials")
    each = judged(listed(some, "credentials"), max_owners, max_repositories, every)
    places = each.where(F.col("live") & ((F.col("kind") < 3) | F.col("value").rlike(SHAPE))).groupBy("serial").agg(F.sort_array(F.collect_set(F.struct("at", "end"))).alias("places"))
    part = lambda a, n: F.substring(F.col("text"), (a + 1).cast("int"), n.cast("int"))
    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("done"))
    # a place that begins before the last one's end only lengthens it
    step = lambda acc, p: F.struct(
        F.when((p["at"] < acc["done"]) & (F.size(acc["parts"]) > 0), acc["parts"]).otherwise(F.concat(acc["parts"], F.array(part(acc["done"], p["at"] - acc["done"]), F.lit(mark)))).alias("parts"),
        F.greatest(acc["done"], p["end"]).alias("done"),
    )
    fixed = F.aggregate("places", begin, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), part(acc["done"], F.length("text"))))
    changed = some.join(places, "serial", "left").withColumn("any", F.col("places").isNotNull())
    changed = changed.withColumn("text", F.when(F.col("any"), fixed).otherwise(F.col(f"row.`{text}`")))
    return docs.where(~possible).unionByName(in_files(_unpacked(docs, changed, text), some.count(), TEXT_ROWS))


def scan_sql() -> str:
    """The same in DuckDB's SQL, whose patterns have no look-around: runs are taken whole and judged afterwards."""
    names = "password passwd secret token api_?key".split()
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in names)
    assign = ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{either})").replace("'", "''")
    patterns = [assign, "AKIA[A-Z0-9]+", "[0-9a-f]+", f"{RUN}+"]
    matches = " UNION ALL ".join(f"SELECT serial, {k} AS kind, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d" for k, p in enumerate(patterns))
    listed = lambda which: f"coalesce(string_agg(CASE kind {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER ({which}), '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS serial, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS repository FROM documents),
     m AS ({matches}),
     e AS (SELECT serial, kind, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap FROM m WHERE len(hits) > 0),
     s AS (SELECT serial, kind, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY serial, kind ORDER BY i))::BIGINT AS stop FROM e),
     c AS (SELECT serial, kind, hit, stop - length(hit) AS start, stop FROM s WHERE CASE kind
            WHEN 0 THEN length(regexp_extract(hit, '{assign}', 1)) >= {ASSIGN_LENGTH} WHEN 1 THEN length(hit) >= 18 WHEN 2 THEN length(hit) >= 16
            ELSE length(hit) >= 16 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') END),
     o AS (SELECT hit, count(DISTINCT split_part(repository, '/', 1)) <= {MAX_OWNERS} AND count(DISTINCT repository) <= {MAX_REPOSITORIES} AS live FROM c JOIN d USING (serial) WHERE kind = 3 GROUP BY hit),
     a AS (SELECT c.*, kind = 3 AND o.live AS live, kind = 3 AND NOT o.live AS copied FROM c LEFT JOIN o USING (hit))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256({listed("kind < 3")}) AS base_sha256, {listed("kind < 3 OR live")} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
FROM d LEFT JOIN a USING (serial) GROUP BY d.serial, d.doc_id
"""

"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seed entities are what four fixed forms (email, ip, card, phone) match, and secrets in their published forms (access key
numbers, values assigned to names like password). Every token with a digit or an at sign is a candidate: it is an occurrence
of an instance, the token itself, under three lexical patterns: the word before it and its shape, its shape and the word
behind it, and its own beginning and shape. Patterns and instances score each other over the graph of their occurrences, in
rounds: a pattern is as sure as its instances on average; an instance is as sure as the share of its occurrences that seeds
cover, or as the surest *other* pattern that it stands under, so no pattern vouches for itself. A pattern counts from
MIN_SUPPORT occurrences on and with MIN_KNOWN different instances that are believed, be it for seeds or for what other
patterns found. Candidates that no seed covers, under a pattern of MIN_CONFIDENCE, are found identifiers of kind `id`.

Regular expressions say where a match is only through what lies between matches: split() with the same expression gives
the gaps. The pass over the texts keeps lengths of gaps and matches; running sums over them, in a window for each text, give
code points. Time grows with a text's length, however many matches it has.

Defined results: a null or empty text has no spans, and the hash of nothing; rows are judged each for itself, repeated
doc_ids and null ones too, and count in the statistics as often as they occur; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality import let

KINDS = ("email", "ip", "card", "phone")
#: The contract's forms, written so that each start is tried once: possessive runs, begun where no run goes on. \G lets a
#: run begin where the match before ended.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Other seeds: numbers of access keys, and values with a digit that are assigned to a name which says that they are secret.
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|secret|token|api[_-]?key)[\x20]?[=:][\x20]?[\"']?(?=[A-Za-z_+/.-]*+[0-9])[A-Za-z0-9_+/.-]{8,}+)"
SECRET_WORDS = r"(?i)AKIA|passw|secret|token|api[_-]?key"
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*+"
#: Places of kinds in spans; a candidate is none yet.
NAMES = (*KINDS, "secret", "id")
SECRET_KIND, ID_KIND, CANDIDATE_KIND = len(KINDS), len(KINDS) + 1, len(KINDS) + 2
ROUNDS = 3
MIN_SUPPORT, MIN_KNOWN, MIN_CONFIDENCE, BELIEVED = 3, 2, 0.8, 0.5
MIN_LENGTH = 5

_MATCH = "array<struct<kind:int,k:int,gap:int,len:int,lead:int,core:int,instance:string,patterns:array<string>>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def total(r: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: let(F.substring(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
        return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0

    return let(F.reverse(digits), total)


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return let(_digits(x), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def shape(x: Column) -> Column:
    """Letters as a, digits as 9, runs as one; runs of both mixed as x."""
    flat = F.regexp_replace(F.regexp_replace(x, r"\p{L}+", "a"), "[0-9]+", "9")
    return F.regexp_replace(flat, "[a9]{3,}", "x")


def matches(text: Column, form: str, kind: int, one, may: Column) -> Column:
    """_MATCH of a form's matches: length of the gap before each, its own, and what one(match, gap before, gap behind) adds or
    null to leave it out of what is found (it still counts for the places of later ones)."""

    def all_(x: Column) -> Column:
        return F.transform(x["m"], lambda m, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(F.get(x["g"], k)).alias("gap"), F.length(m).alias("len"), *one(m, F.get(x["g"], k), F.get(x["g"], k + 1))))

    none = F.array().cast(_MATCH)
    return F.when(may, let(F.struct(F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("m"), F.split(text, form, -1).alias("g")), all_).cast(_MATCH)).otherwise(none)


def _fixed(kind: str):
    def one(m: Column, _: Column, __: Column) -> list[Column]:
        good = F.lit(True) if kind == "secret" else valid(kind, m)
        return [F.lit(0).alias("lead"), F.when(good, F.length(m)).alias("core"), F.lit("").alias("instance"), F.array().cast("array<string>").alias("patterns")]

    return one


def _candidate(m: Column, before: Column, behind: Column) -> list[Column]:
    """The token without punctuation at its ends, and its patterns."""
    core = F.regexp_extract(m, r"^[^\p{L}0-9+(]*+(.*?)[^\p{L}0-9)]*$", 1)
    lead = F.length(F.regexp_extract(m, r"^[^\p{L}0-9+(]*+", 0))
    left = F.lower(F.regexp_extract(before, r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*$", 1))
    right = F.lower(F.regexp_extract(behind, r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1))

    def patterns(s: Column) -> Column:
        return F.array(F.concat(F.lit("l "), left, F.lit(" "), s), F.concat(F.lit("r "), s, F.lit(" "), right), F.concat(F.lit("i "), F.lower(F.substring(core, 1, 4)), F.lit(" "), s))

    return [lead.alias("lead"), F.when(F.length(core) >= MIN_LENGTH, F.length(core)).alias("core"), core.alias("instance"), let(shape(core), patterns).alias("patterns")]


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, row (a key of its own) and found (_MATCH, by kind and place) of docs (doc_id, text): the only pass over the
    texts."""

    def all_(t: Column) -> Column:
        digit = t.rlike("[0-9]")
        may = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+"))}
        each = [matches(t, FORMS[kind], k, _fixed(kind), may.get(kind, digit)) for k, kind in enumerate(KINDS)]
        each.append(matches(t, SECRET, SECRET_KIND, _fixed("secret"), digit & t.rlike(SECRET_WORDS)))
        each.append(matches(t, CANDIDATE, CANDIDATE_KIND, _candidate, t.rlike("[0-9@]")))
        return F.concat(*each)

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), let(F.coalesce(F.col("text"), F.lit("")), all_).alias("found"))


def located(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, instance, patterns, seed): spans in code points, and candidates; seed: whether a span meets
    the candidate."""
    m = found.select("row", F.explode("found").alias("m")).select("row", "m.*")
    by = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap") + F.col("len")).over(by) - F.col("len") + F.col("lead")
    at = m.withColumn("start", start.cast("int")).filter("core is not null").select("row", "kind", "start", (F.col("start") + F.col("core")).alias("end"), "instance", "patterns")
    span = F.col("kind") != CANDIDATE_KIND
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reached, next_ = F.max(F.when(span, F.col("end"))).over(before), F.min(F.when(span, F.col("start"))).over(behind)
    return at.withColumn("seed", (F.coalesce(reached, F.lit(0)) > F.col("start")) | F.coalesce(next_ < F.col("end"), F.lit(False)))


def confident_patterns(cand: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, m, confidence) of patterns that may find new identifiers; cand: instance, patterns, seed. m: about how many
    candidates stand under the pattern."""
    occ = cand.select(F.explode("patterns").alias("pattern"), "instance", "seed")
    edges = common.cut(occ.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds")))
    first = common.cut(edges.groupBy("instance").agg((F.sum("seeds") / F.sum("n")).alias("share"), F.count("*").alias("m")))
    edges = common.cut(common.join_hot(edges, first, ["instance"], "m").select("pattern", "instance", "n", "share"))
    scored = edges.withColumn("score", F.col("share"))
    for k in range(rounds):
        believed = F.sum((F.col("score") >= BELIEVED).cast("long"))
        pattern = scored.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("confidence"), F.sum("n").alias("m"), believed.alias("known"))
        pattern = common.cut(pattern.filter(f"m >= {MIN_SUPPORT} and known >= {MIN_KNOWN}").drop("known"))
        if k == rounds - 1:
            break
        place = F.row_number().over(Window.partitionBy("instance").orderBy(F.col("confidence").desc(), "pattern"))
        two = common.join_hot(edges.select("pattern", "instance"), pattern, ["pattern"], "m").withColumn("place", place).filter("place <= 2")
        top = lambda c, j: F.max(F.when(F.col("place") == j, F.col(c)))
        best = two.groupBy("instance").agg(top("pattern", 1).alias("by"), top("confidence", 1).alias("best"), top("confidence", 2).alias("next"))
        best = common.cut(best.join(first.select("instance", "m"), "instance"))
        other = F.when(F.col("by") == F.col("pattern"), F.col("next")).otherwise(F.col("best"))
        joined = common.join_hot(edges, best, ["instance"], "m", "left")
        scored = joined.select("pattern", "instance", "n", F.greatest("share", F.coalesce(other, F.lit(0.0))).alias("score"))
    return pattern.filter(f"confidence >= {MIN_CONFIDENCE}")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """Counts, hash and spans of each row of docs (doc_id, text)."""
    found = common.cut(extract(docs))
    at = common.cut(located(found))
    cand = at.filter(f"kind = {CANDIDATE_KIND}").select("row", "start", "end", "instance", "patterns", "seed")
    sure = common.cut(confident_patterns(cand).select("pattern", "m"))
    under = cand.filter("not seed").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    new = common.join_hot(under, sure, ["pattern"], "m").select("row", "start", F.lit(ID_KIND).alias("kind"), "end").distinct()
    every = at.filter(f"kind <> {CANDIDATE_KIND}").select("row", "start", "kind", "end").unionByName(new)
    spans = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    full = found.select("row", "doc_id").join(spans, "row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    return full.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_joined(F.filter("s", lambda x: x["kind"] < len(KINDS))), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"),
        count(SECRET_KIND).alias("n_secret"), count(ID_KIND).alias("n_id"), F.size("s").cast("long").alias("n_spans"),
    )


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return detect(common.table(spark, sf_dir, "documents"))


def op4_base_digest(spark, sf_dir: str) -> DataFrame:
    """What the four fixed forms alone decide, which SQL can say too."""
    return op4_pii(spark, sf_dir).select("doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256")


#: The contract's forms, as SQL's expressions find them: leftmost, without overlap.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FOUND = " UNION ALL ".join(f"SELECT row, '{kind}' AS kind, {k} AS place, regexp_extract_all(text, '{form}') AS ms, regexp_split_to_array(text, '{form}') AS gs FROM t" for k, (kind, form) in enumerate(_PLAIN.items()))
SQL = {"op4_base_digest": rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), m AS ({_FOUND}),
x AS (SELECT row, kind, place, ms[i] AS x, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d,
    list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0)),
good AS (SELECT * FROM x WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
  WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0
  ELSE length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(d), i::INTEGER, 1)::INTEGER
    ELSE 2 * substr(reverse(d), i::INTEGER, 1)::INTEGER - CASE WHEN substr(reverse(d), i::INTEGER, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END),
s AS (SELECT row, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _PLAIN)}, string_agg(kind || ':' || start::BIGINT || ':' || (start + length(x))::BIGINT, ',' ORDER BY start, place) AS spans FROM good GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PLAIN)}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN s ON t.row = s.row
"""}

"""Secret scan with multipart linking, in DataFrame expressions only.

Base findings are what a pattern alone tells: assignments to a secret's name,
access keys, long hex runs. Weak candidates are too common to report alone:
account identifiers, long mixed tokens, endpoints of services. They are
reported only beside what complements them, fewer than ``REACH`` code points
away: an identifier beside a secret, a secret beside an identifier, an
endpoint beside both; base findings count as parts (access keys identify,
assignments and hex runs are secrets). A weak token that overlaps a base
finding or an identifier is that finding's own text and no candidate.

Spans come from the pieces between matches, so a text is matched by Spark's
expressions and its offsets are running sums of lengths. Linking is an
interval join: a part's scope, its span widened by ``REACH``, is cut into bins
of ``BIN`` code points, and spans meet by text and bin. A bin holds few spans,
since those of a kind never overlap, so a text with a third of all parts is
spread over its bins and no pairs pile up; only the candidates move.

A null text counts as empty and has no spans; rows are scanned one by one,
whatever their ids, null ids included; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.scratch import materialize

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")  # in order of output
REACH = 200
BIN = 1024
_CHUNK = 64


def either_case(word: str) -> str:
    """Pattern of an ASCII word, its letters in either case and in no other."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def _assigned(names: tuple[str, ...], value: str) -> str:
    return f"""({'|'.join(map(either_case, names))})["']?\\x20*[:=]\\x20*["']?({value})"""


# fixed values: the base patterns of the contract (a run of at least n is the contract's run with its test of length)
ASSIGN = _assigned(("password", "passwd", "secret", "token", "api_?key"), "[A-Za-z0-9+/_.=-]+")
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# weak candidates
IDENTIFIER = _assigned(("client_?id", "account_?id", "access_?key_?id", "user_?name", "login"), "[A-Za-z0-9_.@-]{4,}")
TOKEN = "[A-Za-z0-9+/_-]{32,}=*"
ENDPOINT = "(?:https?|ftps?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqps?)://[A-Za-z0-9._-]+(?::[0-9]+)?"

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often and however deep ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def _running_sums(steps: Column) -> Column:
    """Inclusive running sums of a non-empty array, chunk by chunk so that long arrays stay cheap."""
    def cut(whole: Column) -> Column:
        last = F.floor((F.size(whole) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(whole, c * _CHUNK + 1, F.lit(_CHUNK)))

    def summed(chunks: Column, sums: Column) -> Column:
        return F.flatten(F.transform(chunks, lambda chunk, c: _let(_total(F.slice(sums, F.lit(1), c)), lambda before: F.transform(
            chunk, lambda x, i: before + _total(F.slice(chunk, F.lit(1), i + 1))))))
    return _let(steps, lambda whole: _let(cut(whole), lambda chunks: _let(
        F.transform(chunks, _total), lambda sums: summed(chunks, sums))))


def _spans(found: Column, pieces: Column, kind: str, keep=None) -> Column:
    """(start, kind, end) of the matches ``found`` between ``pieces``, those that pass ``keep``."""
    steps = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, gap: F.length(gap) + F.length(m))
    number = F.lit(KINDS.index(kind))
    spans = F.zip_with(_running_sums(steps), found, lambda end, m: F.struct(
        (end - F.length(m)).cast("int").alias("start"), number.alias("kind"), end.cast("int").alias("end"),
        (keep(m) if keep else F.lit(True)).alias("kept")))
    chosen = F.transform(F.filter(spans, lambda s: s["kept"]), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.when(F.size(found) > 0, chosen).otherwise(F.array().cast(_SPANS))


def _add(rows: DataFrame, name: str, kind: str, pattern: str, when: Column | None = None, keep=None) -> DataFrame:
    """Adds ``name``, the spans of a pattern in ``_text`` of the rows that ``when`` holds for."""
    when = F.lit(True) if when is None else when
    found = F.when(when, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_found", found)
    rows = rows.withColumn("_pieces", F.when(F.size("_found") > 0, F.split("_text", pattern, -1)))
    return rows.withColumn(name, _spans(F.col("_found"), F.col("_pieces"), kind, keep)).drop("_found", "_pieces")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, base, weak): spans of the base findings and of the weak candidates of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = _add(rows, "_assign", "assign", ASSIGN, keep=lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    rows = _add(rows, "_access", "access", ACCESS, F.contains("_text", F.lit("AKIA")))
    rows = _add(rows, "_hex", "hex", HEX)
    rows = _add(rows, "_ident", "identifier", IDENTIFIER)
    # parts that nothing in the text can complement are not looked for
    named = (F.size("_ident") > 0) | (F.size("_access") > 0)
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    rows = _add(rows, "_token", "secret", TOKEN, named, mixed)
    hidden = (F.size("_assign") > 0) | (F.size("_hex") > 0) | (F.size("_token") > 0)
    rows = _add(rows, "_service", "endpoint", ENDPOINT, named & hidden)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat("_assign", "_access", "_hex").alias("base"),
                       F.concat("_ident", "_token", "_service").alias("weak"))


def _binned(spans: DataFrame, reach: int) -> DataFrame:
    """A row per bin of the spans widened by ``reach``."""
    lo, hi = F.col("start") - reach, F.col("end") + reach
    first, last = F.floor(lo / BIN).cast("int"), F.floor((hi - 1) / BIN).cast("int")
    return spans.select("row", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(first, last)).alias("bin"))


def beside(spans: DataFrame, parts: DataFrame, reach: int, how: str = "left_semi") -> DataFrame:
    """Interval join: the ``spans`` (row, start, kind, end) fewer than ``reach`` from one of ``parts`` (or from none: left_anti).

    With a reach of 0 the two must overlap.
    """
    scopes = _binned(parts, reach).select(F.col("row").alias("_row"), F.col("bin").alias("_bin"), "lo", "hi")
    bins = F.explode(F.sequence(F.floor(F.col("start") / BIN).cast("int"), F.floor((F.col("end") - 1) / BIN).cast("int")))
    own = spans.withColumn("_b", bins)
    met = own.join(scopes, (F.col("row") == F.col("_row")) & (F.col("_b") == F.col("_bin")) & (F.col("start") < F.col("hi"))
                   & (F.col("lo") < F.col("end")), "left_semi").select("row", "start", "kind", "end").distinct()
    return met if how == "left_semi" else spans.join(met, ["row", "start", "kind", "end"], "left_anti")


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, start, kind, end): the weak candidates of ``parts`` (row, base, weak) that complementary parts stand beside."""
    kind = {name: i for i, name in enumerate(KINDS)}
    some = parts.where(F.size("weak") > 0)
    base, weak = (materialize(some.select("row", F.explode(c).alias("s")).select("row", "s.*"), c) for c in ("base", "weak"))
    ident, token, service = (weak.where(F.col("kind") == kind[k]) for k in ("identifier", "secret", "endpoint"))
    token = beside(token, base.unionByName(ident), 0, "left_anti")
    ident = beside(ident, base, 0, "left_anti")
    names = base.where(F.col("kind") == kind["access"]).unionByName(ident)
    hidden = base.where(F.col("kind").isin(kind["assign"], kind["hex"])).unionByName(token)
    return beside(ident, hidden, reach).unionByName(beside(token, names, reach)).unionByName(
        beside(beside(service, names, reach), hidden, reach))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and linked), n_linked."""
    parts = materialize(scan(docs, doc_id, text), "parts")
    added = linked(parts, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    rows = parts.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(_SPANS)))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return rows.select("doc_id", *map(count, range(3)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                       _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_linked"))


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENTIFIER, TOKEN, ENDPOINT)))
_FOUND_SQL = " UNION ALL ".join(
    f"SELECT rid, {i} AS k, {_quoted(p)} AS p, unnest(regexp_extract_all(t, {_quoted(p)})) AS m, unnest(string_split_regex(t, {_quoted(p)})) AS gap,"
    f" unnest(range(len(regexp_extract_all(t, {_quoted(p)})) + 1)) AS i FROM docs" for i, p in enumerate(_PATTERNS.values()))

OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND_SQL}),
placed AS (
  SELECT rid, k, m, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY rid, k ORDER BY i) AS e FROM found),
spans AS (
  SELECT rid, k, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM placed WHERE m IS NOT NULL
    AND (k <> 0 OR length(regexp_extract(m, {_quoted(ASSIGN)}, 2)) >= 6)
    AND (k <> 4 OR (regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')))),
idents AS (SELECT * FROM spans a WHERE k = 3 AND NOT EXISTS (
  SELECT 1 FROM spans b WHERE b.rid = a.rid AND b.k < 3 AND b.s < a.e AND a.s < b.e)),
tokens AS (SELECT * FROM spans a WHERE k = 4 AND NOT EXISTS (
  SELECT 1 FROM spans b WHERE b.rid = a.rid AND b.k <= 3 AND b.s < a.e AND a.s < b.e)),
names AS (SELECT * FROM spans WHERE k = 1 UNION ALL SELECT * FROM idents),
hidden AS (SELECT * FROM spans WHERE k IN (0, 2) UNION ALL SELECT * FROM tokens),
weak AS (SELECT * FROM idents UNION ALL SELECT * FROM tokens UNION ALL SELECT * FROM spans WHERE k = 5),
linked AS (
  SELECT * FROM weak w
  WHERE (k = 3 OR EXISTS (SELECT 1 FROM names p WHERE p.rid = w.rid AND w.s < p.e + {REACH} AND p.s - {REACH} < w.e))
    AND (k = 4 OR EXISTS (SELECT 1 FROM hidden p WHERE p.rid = w.rid AND w.s < p.e + {REACH} AND p.s - {REACH} < w.e))),
listed AS (
  SELECT rid, k, s, {list(KINDS)}[k + 1] || ':' || s || ':' || e AS item FROM (
    SELECT * FROM spans WHERE k < 3 UNION ALL SELECT * FROM linked)),
told AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(item, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(item, ',' ORDER BY s, k) AS spans,
         count(*) FILTER (k > 2) AS n_linked FROM listed GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM docs LEFT JOIN told USING (rid)
"""

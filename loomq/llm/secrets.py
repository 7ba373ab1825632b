"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for candidates; the hashes of their values are aggregated over the corpus by distinct repositories
and owners. A value that many owners carry, or very many repositories of whatever owner, is a copied example; one that stays
with its owner and doesn't look like a placeholder is live-looking.

Every pattern takes time linear in the text: a run of characters is looked at a bounded number of times.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.llm.common import apart, documents_of, map_batches, record_batch, texts
from loomq.session import expose_package, materialize, store

#: Distinct owners, or distinct repositories, from which on a value counts as a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 50
#: Shannon entropy, in bits a character, below which a value looks like a placeholder.
PLACEHOLDER_BITS = 2.0

# The base kinds in their order, with the words without which a pattern can't match.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the same runs as [0-9a-f]+ of 24 characters and more
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Published formats of further credentials, each with a literal it contains. Runs are possessive, and one
# that failed can't be entered again in its middle.
_FORMATS = (
    ("private_key", "PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]*PRIVATE KEY-----")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+")),
    ("bearer", "earer ", re.compile(r"\b[Bb]earer [A-Za-z0-9+/_.~-]{20,}+=*+")),
    ("prefixed", "_", re.compile(r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+)")),
    ("prefixed", "glpat-", re.compile(r"(?<![A-Za-z0-9_-])glpat-[A-Za-z0-9_-]{20,}+")),
)
_USER_AND_PASSWORD = re.compile(r"://[^\s/:@]++:[^\s/:@]++@")
_SCHEME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-"
# Words that a placeholder has as a whole part, and ends of documented examples.
_PLACEHOLDER_WORDS = re.compile(r"(?:your|example|sample|dummy|placeholder|changeme|change|test|testing|foobar|redacted|xxx+|(?:example|test|sample|dummy|your|my)(?:key|token|password|secret))\d{0,4}", re.A)
_EXAMPLE_END = re.compile(r"EXAMPLE(?:KEY)?$")
KINDS = ("assign", "access", "hex", "private_key", "jwt", "bearer", "prefixed", "url_password")

_FOUND = "array<struct<kind:string,start:long,end:long,value_start:long,value_end:long,hash:string,placeholder:boolean>>"
SCAN = f"doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found {_FOUND}"
_FIND = pa.struct(
    [("kind", pa.string())] + [(c, pa.int64()) for c in ("start", "end", "value_start", "value_end")] + [("hash", pa.string()), ("placeholder", pa.bool_())]
)
_SCAN = pa.schema(
    [("doc_id", pa.int64()), ("owner", pa.string()), ("repository", pa.string())] + [(c, pa.int64()) for c in ("n_assign", "n_access", "n_hex")]
    + [("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(_FIND))]
)


def find(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) in code points, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        found += [("assign", *m.span(), *m.span(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span(), *m.span()) for m in _HEX.finditer(text)]
    for kind, literal, pattern in _FORMATS:
        if literal in text:
            found += [(kind, *m.span(), *m.span()) for m in pattern.finditer(text)]
    if "://" in text:
        found += [("url_password", a, b, a, b) for a, b in _addresses(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _addresses(text: str) -> list[tuple[int, int]]:
    """scheme://user:password@ spans. The scheme is read backwards from its "://", never beyond the one before."""
    found, done = [], 0
    for m in _USER_AND_PASSWORD.finditer(text):
        before = text[max(done, text.rfind("://", done, m.start())) : m.start()]
        scheme = before[len(before.rstrip(_SCHEME)) :].lstrip(_SCHEME[52:])
        if scheme:
            found.append((m.start() - len(scheme), m.end()))
        done = m.end()
    return found


def looks_like_placeholder(value: str) -> bool:
    """Little entropy, or a placeholder's word as a whole part of the value; such a word inside a longer one is chance."""
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    parts = re.split("[^a-z0-9]+", value.lower())
    return bits < PLACEHOLDER_BITS or bool(_EXAMPLE_END.search(value)) or any(map(_PLACEHOLDER_WORDS.fullmatch, parts))


def _joined(found: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in found)


def _scan_batch(rows: pa.RecordBatch) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(6)]
    for text in texts(rows):
        found = find(text)
        base = [x for x in found if x[0] in KINDS[:3]]
        counts = Counter(x[0] for x in base)
        details = []
        for kind, start, end, a, b in found:
            value = text[a:b]
            digest = hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()
            details.append(dict(kind=kind, start=start, end=end, value_start=a, value_end=b, hash=digest, placeholder=looks_like_placeholder(value)))
        row = (*(counts[k] for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), details)
        for column, value in zip(out, row):
            column.append(value)
    return record_batch(_SCAN, [rows.column("doc_id"), rows.column("owner"), rows.column("repository"), *out])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """The candidates of every text, without verdicts; no shuffle. A null text has none."""
    docs = documents_of(df, id_col, text_col, owner=owner_col, repository=repository_col)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("owner", "repository")]
    return map_batches(docs.select("doc_id", "text", *named), _scan_batch, SCAN)


def ownership(candidates: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per hash: distinct owners, distinct repositories and whether it is an example by either.

    Counts come from three aggregations with map-side combination, the first by (hash, owner, repository), so that a
    value which a third of all rows carry is spread until it has been reduced to one row for each owner. A repository is
    told by its owner and name.
    """
    once = candidates.select("hash", "owner", "repository").distinct()
    owned = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    owners = owned.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))
    return owners.withColumn("copied", (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories))


def judge(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Verdicts of scanned rows with a unique column row: row, n_live, n_example, the most owners and repositories of one
    of its values, and live (the found entries that are)."""
    one = scanned.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    owners = ownership(one, example_owners, example_repositories)
    verdicts = one.drop("owner", "repository").join(apart(owners, "hash"), "hash", "left")  # one value may be in many rows
    example = F.col("copied") | F.col("placeholder")
    return verdicts.groupBy("row").agg(
        F.count_if(~example).alias("n_live"), F.count_if(example).alias("n_example"), F.max("n_owners").alias("n_owners"), F.max("n_repositories").alias("n_repositories"),
        F.sort_array(F.collect_list(F.when(~example, F.struct("start", "end", "value_start", "value_end", "kind")))).alias("live"),
    )


def secrets(df: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, **columns: str) -> DataFrame:
    """One row per document: the base counts and digest, all spans, live-looking and example candidates, and the most
    distinct owners and repositories that one of its values has.

    Offsets are code points, ends exclusive; spans are joined as kind:start:end by start and then kind. A null or empty
    text has no candidates; null owners and repositories count as one unnamed each; repeated rows stay apart. The rows
    without candidates, nearly all, take no part in a shuffle.
    """
    scanned = materialize(scan(df, **columns).withColumn("row", F.monotonically_increasing_id()))
    some = scanned.filter(F.size("found") > 0)
    judged = some.join(judge(some, example_owners, example_repositories), "row", "left")
    kept, counts = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], ["n_live", "n_example", "n_owners", "n_repositories"]
    none = scanned.filter(F.size("found") == 0).select(*kept, *[F.lit(0).cast("long").alias(c) for c in counts])
    return judged.select(*kept, *counts).unionByName(none)


def _found_batch(column: pa.Array) -> pa.Array:
    rows = pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column.cast(pa.string()), *[pa.nulls(len(column), pa.string())] * 2],
                                      names=["doc_id", "text", "owner", "repository"])
    return _scan_batch(rows).column("found")


def redact(
    df: DataFrame, mask: str = "[SECRET]", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, text_col: str = "text",
    owner_col: str = "source", repository_col: str = "doc_id", length_col: str | None = None,
) -> DataFrame:
    """The same rows and columns, the values of live-looking candidates replaced by a mask; length_col is kept right.

    Examples stay as they are. A text without live-looking candidates isn't changed at all, nor is a null text. Texts
    are scanned once, and the rows written with what was found; only those with candidates are joined.
    """
    expose_package(df.sparkSession)
    text, unnamed = F.col(f"`{text_col}`"), F.lit("")
    found = F.arrow_udf(_found_batch, _FOUND)
    docs = store(df.withColumn("__found", found(text)).withColumn("__row", F.monotonically_increasing_id()), "scanned")
    none, some = docs.filter(F.size("__found") == 0), docs.filter(F.size("__found") > 0)
    owner, repository = (F.coalesce(F.col(f"`{c}`").cast("string"), unnamed) for c in (owner_col, repository_col))
    scanned = some.select(F.col("__row").alias("row"), F.col("__found").alias("found"), owner.alias("owner"), repository.alias("repository"))
    live = judge(scanned, example_owners, example_repositories).select(F.col("row").alias("__row"), F.col("live").alias("__live"))
    joined = some.join(live, "__row", "left").withColumn("__text", _mask(text, F.col("__live"), mask))
    out = joined.withColumn(text_col, F.col("__text"))
    if length_col:
        length = F.length("__text").cast(df.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.size("__live") > 0, length).otherwise(F.col(f"`{length_col}`")))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return none.select(*columns).unionByName(out.select(*columns))


def _mask(text: Column, live: Column, mask: str) -> Column:
    """The text with the values of the live entries replaced; entries with overlapping values are one."""
    values = F.array_sort(F.transform(live, lambda x: F.struct(x["value_start"].alias("a"), x["value_end"].alias("b"))))
    kept = F.concat_ws("", F.lit(""))
    state = F.struct(kept.alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        inside = x["b"] <= acc["at"]  # covered by the value before it
        start = F.greatest(x["a"], acc["at"])
        between = F.substring(text, acc["at"].cast("int") + 1, (start - acc["at"]).cast("int"))
        added = F.when(x["a"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], between, F.lit(mask)))
        return F.struct(F.when(inside, acc["out"]).otherwise(added).alias("out"), F.greatest(acc["at"], x["b"]).alias("at"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text)))

    return F.when(F.size(live) > 0, F.aggregate(values, state, step, finish)).otherwise(text)


def _oracle() -> str:
    """DuckDB SQL for secrets() with its defaults.

    A pattern is (what stands before)(the match); a match's place is the length of all pieces and matches before it.
    """
    letter = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
    space = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    names = "|".join([*map(letter, ("password", "passwd", "secret", "token")), f"{letter('api')}_?{letter('key')}"])
    start, word = "(^|[^A-Za-z0-9_-])", r"(^|[^\p{L}\p{N}_])"
    patterns = (
        ("assign", rf"""()((?:{names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))""", 3, 6), ("access", "()(AKIA[A-Z0-9]+)", 2, 20), ("hex", "()([0-9a-f]{24,})", 2, 24),
        ("private_key", rf"()(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/={space}]*-----END [A-Z ]*PRIVATE KEY-----)", 2, 1),
        ("jwt", rf"{start}(eyJ[A-Za-z0-9_-]{{10,}}\.eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}})", 2, 1), ("bearer", rf"{word}([Bb]earer [A-Za-z0-9+/_.~-]{{20,}}=*)", 2, 1),
        ("prefixed", rf"{start}(gh[pousr]_[A-Za-z0-9]{{36,}}|[sr]k_(?:live|test)_[A-Za-z0-9]{{16,}})", 2, 1), ("prefixed", rf"{start}(glpat-[A-Za-z0-9_-]{{20,}})", 2, 1),
        ("url_password", rf"()([A-Za-z][A-Za-z0-9+.-]*://[^{space}/:@]+:[^{space}/:@]+@)", 2, 1),
    )
    each = " UNION ALL ".join(
        f"SELECT r, '{kind}' AS kind, {KINDS.index(kind)} AS o, {least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', 1) AS l, "
        f"regexp_extract_all(t, '{p}', {value}) AS v, string_split_regex(t, '{p}') AS b FROM d WHERE regexp_matches(t, '{p}')"
        for kind, p, value, least in patterns
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
a AS ({each}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a),
f AS (SELECT r, kind, o, v[i] AS v, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length(l[i]) AS BIGINT) AS s,
             length(m[i]) - length(l[i]) AS n FROM i WHERE length(v[i]) >= least),
w AS (SELECT f.*, d.owner, coalesce(CAST(d.doc_id AS VARCHAR), '') AS repository, list_aggregate(string_split(v, ''), 'entropy') < {PLACEHOLDER_BITS} OR regexp_matches(v, '{_EXAMPLE_END.pattern}')
             OR len(list_filter(string_split_regex(lower(v), '[^a-z0-9]+'), lambda x: regexp_full_match(x, '{_PLACEHOLDER_WORDS.pattern}'))) > 0 AS placeholder FROM f JOIN d ON d.r = f.r),
c AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repository)) AS n_repositories FROM w GROUP BY v),
g AS (SELECT w.r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) FILTER (WHERE o < 3) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) AS spans,
             count(*) FILTER (WHERE placeholder OR n_owners >= {EXAMPLE_OWNERS} OR n_repositories >= {EXAMPLE_REPOSITORIES}) AS n_example, count(*) AS n_all,
             max(n_owners) AS n_owners, max(n_repositories) AS n_repositories FROM w JOIN c ON c.v = w.v GROUP BY w.r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_all - n_example, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_owners, 0) AS n_owners, coalesce(n_repositories, 0) AS n_repositories FROM d LEFT JOIN g ON g.r = d.r
"""


ORACLE = _oracle()
